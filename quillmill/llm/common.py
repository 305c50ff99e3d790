"""What the operators of this subpackage share: reading tables, cutting lineage, Arrow plumbing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from quillmill.sources.scratch import shared_dir

#: Bytes of text that a Python worker handles at a time, whatever Arrow's batch holds.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % n


def row_mark(id_col: str, text_col: str) -> Column:
    """What tells a document apart: its id, of any type, and its text's hash. Repeated rows share it."""
    return F.concat_ws(":", F.col(id_col).isNull().cast("string"), F.col(id_col).cast("string"), F.hex(F.xxhash64(F.col(text_col).isNull(), F.col(text_col))))


def digest(text: Column) -> Column:
    """128 bits of a text, as binary."""
    return F.unhex(F.md5(text))


def stored(df: DataFrame, what: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read again. Survives lost executors, costs no memory."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillmill-{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    spark.sparkContext._jvm.System.gc()  # shuffle files of finished work go when the driver drops what refers to them
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a stored table that nothing will read again: what came of it is stored itself."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose text holds about ``limit`` bytes; a longer text is a run of its own."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes.astype(np.int64)) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str | StructType, text: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow over slices of bounded size. fn gives a dict of columns (lists or arrays) for a slice."""
    kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    fields = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, limit):
                got = fn(part)
                columns = [x if isinstance(x := got[f.name], pa.Array) else pa.array(x, type=f.type) for f in fields]
                yield pa.RecordBatch.from_arrays([x if x.type == f.type else x.cast(f.type) for x, f in zip(columns, fields)], schema=fields)

    return df.mapInArrow(run, kind)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The column's values as UTF-8, null as empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))

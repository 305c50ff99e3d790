"""Sinks: union headers, canonical order, immutable and atomic writes, manifests with content hashes, blinded packages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ragged_union(parts: list[DataFrame]) -> DataFrame:
    """All rows under the union of all columns, in the order in which they first appear."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


#: Quotes doubled and white space kept, as the CSV scan (and any other reader of RFC 4180) expects them.
CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_csv(parts: list[DataFrame], path: str) -> None:
    ragged_union(parts).write.mode("errorifexists").csv(path, **CSV)


def write_jsonl(df: DataFrame, path: str, order: str) -> None:
    """Rows in order as JSON lines; the path must be new, and appears as a whole when the job commits."""
    df.orderBy(order).write.mode("errorifexists").json(path)


def write_once(df: DataFrame, path: str) -> None:
    """Parquet that is never overwritten."""
    df.write.mode("errorifexists").parquet(path)


def content_hash(df: DataFrame) -> DataFrame:
    """One row: rows and a hash of their contents that depends on neither order nor partitioning: 60 bits of each row's sha256, summed."""
    from quillmill.functions.text import hash_rank

    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(hash_rank(F.to_json(F.struct(*df.columns))).cast("decimal(38,0)")).alias("content"))


def write_manifest(df: DataFrame, path: str, order: str) -> tuple[int, str]:
    """JSON lines in order; gives rows and content hash of what was written, read back."""
    write_jsonl(df, path, order)
    got = content_hash(df.sparkSession.read.schema(df.schema).json(path)).first()
    return got[0], str(got[1])


def read_manifest(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def publish(spark: SparkSession, staging: str, target: str) -> None:
    """Rename a finished folder to its public place; an existing one is an error. One operation of the file system."""
    jvm = spark.sparkContext._jvm
    source, goal = jvm.org.apache.hadoop.fs.Path(staging), jvm.org.apache.hadoop.fs.Path(target)
    fs = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(goal):
        raise FileExistsError(target)
    fs.mkdirs(goal.getParent())
    if not fs.rename(source, goal):
        raise OSError(f"{staging} can't be renamed")


def in_manifest_order(rows: DataFrame, manifest: DataFrame, key: str, position: str) -> DataFrame:
    """Rows by their place in the manifest, unknown ones last."""
    return rows.join(manifest.select(key, position), key, "left").orderBy(F.col(position).asc_nulls_last(), key)


def review_package(pairs: DataFrame, path: str, salt: str) -> None:
    """Two disjoint tables: a blinded sheet (id, source, text A, text B) and the key that says which arm A is."""
    flip = F.substring(F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256), 1, 1) < "8"
    sheet = pairs.select("id", "source", F.when(flip, F.col("first")).otherwise(F.col("second")).alias("a"), F.when(flip, F.col("second")).otherwise(F.col("first")).alias("b"))
    sheet.orderBy("id").write.mode("errorifexists").csv(f"{path}/sheet", **CSV)
    pairs.select("id", F.when(flip, F.col("first_arm")).otherwise(F.col("second_arm")).alias("arm_of_a")).orderBy("id").write.mode("errorifexists").json(f"{path}/key")


def refuse_sealed(path: str, sealed: tuple[str, ...] = ("test",)) -> str:
    """The path, or an error before anything is read, if it lies in a sealed split."""
    if any(part in sealed for part in path.split("/")):
        raise PermissionError(f"{path} is sealed")
    return path

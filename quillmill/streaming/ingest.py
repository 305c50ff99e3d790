"""Incremental ingestion: files that arrive become occurrences and distinct pairs once, by a ledger of paths and hashes.

The tables are versions of Parquet folders beside a small pointer that names the current one; a micro-batch writes a new
version and then moves the pointer. A batch that fails moves nothing, and a batch that runs again finds its files in the
ledger.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.operators.pairs import distinct_pairs

#: Raw records: one JSON object a file or line.
RECORD = "split string, source_id string, source string, generator string, current string, candidates array<struct<text:string,finish_reason:string,slot:int,temperature:double>>"


class Store:
    """Named tables of one folder: read(name) and commit({name: df}), all of a commit or none."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _version(self) -> int:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/commits")
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return max((int(x.getPath().getName()) for x in fs.listStatus(at)), default=0) if fs.exists(at) else 0

    def read(self, name: str, schema: str) -> DataFrame:
        """All rows that are committed. Every commit adds a folder to each table it names."""
        spark, n = self.spark, self._version()
        parts = []
        jvm = spark.sparkContext._jvm
        for v in range(1, n + 1):
            at = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/{v}")
            if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
                parts.append(f"{self.folder}/{name}/{v}")
        return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)

    def commit(self, tables: dict[str, DataFrame]) -> None:
        v = self._version() + 1
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.folder}/{name}/{v}")
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/commits/{v}")
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)


LEDGER = "path string, sha256 string"
OCCURRENCES = "path string, slot int, pair_id string, split string, source_id string, generator string, current string, candidate string, temperature double, reason string, valid boolean, noop boolean"
PAIRS = "pair_id string, path string, slot int, split string, source_id string, generator string, current string, candidate string, temperature double"


def new_files(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """files(path, sha256, ...) that the ledger lacks; a known path with another hash is an error."""
    j = files.join(ledger.withColumnRenamed("sha256", "known"), "path", "left")
    clash = F.col("known").isNotNull() & (F.col("known") != F.col("sha256"))
    return j.where(F.when(clash, F.raise_error(F.concat(F.lit("changed since it was read: "), F.col("path")))).otherwise(F.col("known").isNull())).drop("known")


def cleaned(records: DataFrame) -> DataFrame:
    """Occurrences of records(path, r): one a candidate, with validity; the batch and the stream share this."""
    from quillmill.functions import rules
    from quillmill.functions.text import composite_key

    c = records.select("path", "r.*").select("path", "split", "source_id", "generator", "current", F.posexplode("candidates").alias("at", "c"))
    reason = F.coalesce(rules.pair_reason(F.col("current"), F.col("c.text"), F.col("c.finish_reason")), F.lit("valid"))
    out = c.select("path", F.coalesce("c.slot", "at").alias("slot"), composite_key(F.col("source_id"), F.col("current"), F.col("c.text")).alias("pair_id"), "split", "source_id", "generator", "current", F.col("c.text").alias("candidate"), F.col("c.temperature").alias("temperature"), reason.alias("reason"))
    return out.withColumn("valid", F.col("reason") == "valid").withColumn("noop", F.col("current") == F.col("candidate"))


def ingest_batch(store: Store, files: DataFrame) -> None:
    """One micro-batch of files(path, content): ledger, occurrences and new distinct pairs in a single commit."""
    f = files.select("path", F.sha2("content", 256).alias("sha256"), F.from_json(F.col("content").cast("string"), RECORD).alias("r"))
    fresh = new_files(f, store.read("ledger", LEDGER)).persist()
    try:
        if fresh.isEmpty():
            return
        if not fresh.where(F.col("r.candidates").isNull()).isEmpty():
            raise ValueError("a record doesn't parse")
        occ = cleaned(fresh)
        pairs = distinct_pairs(occ, ["split", "source_id", "path", "slot"]).join(store.read("pairs", PAIRS).select("pair_id"), "pair_id", "left_anti")
        columns = [x.split()[0] for x in OCCURRENCES.split(", ")]
        store.commit({"ledger": fresh.select("path", "sha256"), "occurrences": occ.select(*columns), "pairs": pairs.select(*[x.split()[0] for x in PAIRS.split(", ")])})
    finally:
        fresh.unpersist()


def ingest_all(spark: SparkSession, raw: str, folder: str) -> Store:
    """The whole folder in one batch; running it again adds nothing."""
    store = Store(spark, folder)
    ingest_batch(store, spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(raw).select("path", "content"))
    return store


def ingest_stream(spark: SparkSession, raw: str, folder: str, checkpoint: str, files_per_batch: int = 128) -> Store:
    """The same by Structured Streaming: what is there now, in micro-batches of so many files."""
    store = Store(spark, folder)
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", files_per_batch).load(raw)
    query = files.select("path", "content").writeStream.foreachBatch(lambda df, _: ingest_batch(store, df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return store


def integrity(store: Store, raw: str) -> DataFrame:
    """path, status of all files that are there or in the ledger: ok, changed, missing, unread."""
    from quillmill.sources.readers import file_inventory

    now = file_inventory(store.spark, raw, "*.json").select("path", F.col("sha256").alias("now"))
    j = store.read("ledger", LEDGER).join(now, "path", "full")
    return j.select("path", F.when(F.col("now").isNull(), "missing").when(F.col("sha256").isNull(), "unread").when(F.col("now") != F.col("sha256"), "changed").otherwise("ok").alias("status"))


def micro_batches(items: DataFrame, order: str, size: int, library: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], store: Store, schema: str) -> DataFrame:
    """Batch after batch: step(batch, library as it was before the batch) gives new units, which later batches see.

    A unit carries its birth_batch; the library of a batch is what is committed with a smaller one.
    """
    from quillmill.operators.sampling import in_batches

    store.commit({"library": library.select(*[x.split()[0] for x in schema.split(", ")])})
    numbered = in_batches(items, [order], size).persist()
    for b in range((numbered.agg(F.max("batch")).first()[0] or 0) + 1 if not numbered.isEmpty() else 0):
        seen = store.read("library", schema).where(F.col("birth_batch") < b)
        store.commit({"library": step(numbered.where(F.col("batch") == b), seen)})
    numbered.unpersist()
    return store.read("library", schema)


def finished(progress: DataFrame, initial: int, target: int) -> DataFrame:
    """One row: the stop rule (prefix and retained pairs both reached) over all tasks of progress(task, prefix, retained); false for none."""
    return progress.agg(F.coalesce(F.bool_and((F.col("prefix") >= initial) & (F.col("retained") >= target)), F.lit(False)).alias("done"))


def now_utc() -> str:
    return time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())

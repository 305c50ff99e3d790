"""Scans: Parquet, JSON lines (strict, tolerant, repaired), CSV, and what their paths tell."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.functions.text import split_of_path, strip
from quillmill.operators.ordered import placed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def first_rows(df: DataFrame, order: str, n: int | None) -> DataFrame:
    """The first n rows in the source's own order."""
    return df.orderBy(order).limit(n) if n is not None else df.orderBy(order)


def projected(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Nested fields under new names; Spark reads no other column of the file."""
    return df.select(*[F.col(path).alias(name) for name, path in fields.items()])


def coalesced(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Adds each column as the first non-null of those of its aliases that exist; null if none does."""
    have = set(df.columns)
    return df.withColumns({name: F.coalesce(*[F.col(a) for a in options if a in have], F.lit(None).cast("string")) for name, options in aliases.items()})


def with_global_index(parts: dict[str, DataFrame], order: str) -> DataFrame:
    """All splits in turn, with split and a running index over all in the order of splits and, in each, of a column."""
    tagged = [df.withColumn("split", F.lit(name)).withColumn("__turn", F.lit(turn)) for turn, (name, df) in enumerate(parts.items())]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return placed(rows, [F.col("__turn"), F.col(order)], "global_index").drop("__turn")


def filtered_index(df: DataFrame, keep: Column, order: str, by: list[str] | None = None) -> DataFrame:
    """The rows that are kept, numbered anew from 0, over all or within groups."""
    return placed(df.where(keep), [F.col(order)], "filtered_index", by)


def csv(spark: SparkSession, path: str, usecols: list[str] | None = None) -> DataFrame:
    """Header, quoted line breaks, a byte-order mark before the first name, undecodable bytes as U+FFFD; columns as strings."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    return df.select(*usecols) if usecols else df


def contrastive(df: DataFrame, columns: list[str], wrong: str, right: str) -> tuple[DataFrame, DataFrame]:
    """Trimmed rows that have all columns and a contrast; and one row of what was left out."""
    t = df.withColumns({c: strip(F.coalesce(F.col(c), F.lit(""))) for c in columns})
    empty = F.exists(F.array(*columns), lambda x: x == "")
    same = F.col(wrong) == F.col(right)
    return t.where(~empty & ~same), t.agg(F.count_if(empty).alias("empty"), F.count_if(~empty & same).alias("no_contrast"), F.count(F.lit(1)).alias("rows"))


def json_strict(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; a bad line is an error when the rows are read. Blank lines are skipped."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def json_tolerant(spark: SparkSession, path: str, schema: T.StructType, required: str | None = None) -> DataFrame:
    """JSON lines with a column ``bad``: lines that don't parse, or lack what is required."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    df = spark.read.schema(full).json(path, mode="PERMISSIVE")
    bad = F.col("_corrupt_record").isNotNull() | (F.col(required).isNull() if required else F.lit(False))
    return df.withColumn("bad", bad).drop("_corrupt_record")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no (from 1 in each file), line, open: whether it is the file's last one and lacks its end.

    Large files are read in many splits: a line's place follows from the split's start and its turn there. A file whose
    lines, with an end each, take one byte more than it has (or two less, behind a byte-order mark) lacks the last end.
    """
    meta = F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("__block"), F.col("_metadata.file_size").alias("__size")
    raw = spark.read.text(path, lineSep="\n").select(*meta, F.monotonically_increasing_id().alias("__turn"), F.col("value").alias("line"))
    rows = placed(raw, [F.col("__block"), F.col("__turn")], "line_no", ["path"]).withColumn("line_no", F.col("line_no") + 1)
    over = F.sum(F.octet_length("line") + 1) - F.max("__size")
    files = rows.groupBy("path").agg(F.max("line_no").alias("__last"), over.isin(1, -2).alias("__open"))
    return rows.join(files, "path").select("path", "line_no", "line", (F.col("__open") & (F.col("line_no") == F.col("__last"))).alias("open"))


def json_lines(spark: SparkSession, path: str, schema: T.StructType, drop_last: bool = False) -> DataFrame:
    """path, line_no, row, status: ok, blank, bad, or truncated for a file's last line without its end that doesn't parse.

    drop_last leaves out each file's last unterminated line, parsable or not.
    """
    lines = numbered_lines(spark, path)
    fixed = F.regexp_replace("line", "^\ufeff", "")
    row = F.from_json(fixed, schema, {"mode": "PERMISSIVE"})
    valid = F.try_parse_json(fixed).isNotNull()
    status = F.when(strip(F.col("line")) == "", "blank").when(F.col("open") & (F.lit(drop_last) | ~valid), "truncated").when(valid, "ok").otherwise("bad")
    return lines.withColumn("status", status).withColumn("row", F.when(F.col("status") == "ok", row)).select("path", "line_no", "row", "status")


def require_ok(lines: DataFrame) -> DataFrame:
    """The parsed rows; an error that names file and line at a bad one."""
    said = F.concat(F.lit("bad JSON in "), F.col("path"), F.lit(" line "), F.col("line_no").cast("string"))
    return lines.where(F.when(F.col("status").isin("bad", "truncated"), F.raise_error(said)).otherwise(F.col("status") == "ok")).select("row.*")


def nul_repaired(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """path, line_no, row, repaired: NUL bytes taken out before parsing, and whether a line had any."""
    lines = numbered_lines(spark, path).where(strip(F.col("line")) != "")
    return lines.select("path", "line_no", F.from_json(F.translate("line", "\0", ""), schema).alias("row"), F.contains("line", F.lit("\0")).alias("repaired"))


def discover(spark: SparkSession, glob: str, schema: T.StructType) -> DataFrame:
    """One row a run file: path, arm and tag (of a folder arm__tag), split, task and model of its records, n, whether these agree."""
    df = spark.read.schema(schema).json(glob).withColumn("path", F.col("_metadata.file_path"))
    folder = F.element_at(F.split("path", "/"), -2)
    runs = df.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("task").alias("task"), F.min("model").alias("model"), ((F.count_distinct("task") == 1) & (F.count_distinct("model") == 1)).alias("consistent"))
    return runs.withColumn("arm", F.substring_index(folder, "__", 1)).withColumn("tag", F.when(folder.contains("__"), F.substring_index(folder, "__", -1)).otherwise("")).withColumn("split", split_of_path(F.col("path")))


def complete(runs: DataFrame, expected: dict[str, int]) -> DataFrame:
    """Runs with as many rows as their task has samples; a task that isn't listed expects one."""
    want = F.lit(1)
    for task, n in expected.items():
        want = F.when(F.col("task") == task, n).otherwise(want)
    return runs.where(F.col("n") >= want)


def listed(spark: SparkSession, manifest: DataFrame, schema: T.StructType) -> DataFrame:
    """JSON records of the files that a manifest(path) publishes, with their paths. The list goes to the reader on the driver."""
    paths = [r.path for r in manifest.select("path").distinct().orderBy("path").collect()]
    if not paths:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("path", T.StringType())]))
    return spark.read.schema(schema).json(paths).withColumn("path", F.col("_metadata.file_path"))


def file_inventory(spark: SparkSession, path: str, pattern: str = "*", exclude: str | None = None) -> DataFrame:
    """path, length, sha256 of the files under a folder; contents are hashed where they are read."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    out = df.select("path", "length", F.sha2("content", 256).alias("sha256"))
    return out.where(~F.col("path").rlike(exclude)) if exclude else out

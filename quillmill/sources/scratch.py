"""Tables between the jobs of an operator: in a folder that all executors see, so that a lost executor costs nothing."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. On one machine the warehouse does where it is unset."""
    if found := spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", ""):
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder at which nothing is yet."""
    return f"{shared_dir(spark)}/quillmill-{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """The rows written and read again: what follows depends on files and not on how the rows came about."""
    path = fresh_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

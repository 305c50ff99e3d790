"""The corpus pipeline: filtering and rewriting stages over documents, each written as Parquet and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillmill.llm import bpe, decontaminate, langid, neardup, secrets
from quillmill.llm.common import forget, remainder, shared_dir, table

#: Margin of the two smallest compressed sizes below which a text counts as in no language.
MIN_MARGIN = 0.005


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, and long ones that no language's dictionary helps more than another's, go.

    Null and empty texts have no letter. Repeated rows fare alike; an empty table stays empty.
    """
    return langid.keep_known(docs, langid.fit(docs, remainder("doc_id", 5) != 0), MIN_MARGIN)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts with 0.8 or more of their five-word shingles in common, by links, the one of least id stays.

    Null counts as larger than any id. A row that repeats with id and text stays once; texts without words all stay.
    """
    return neardup.keep_one(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages leave their texts; texts that are mostly benchmark go. Null and empty texts pass."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Values that look live are masked; all rows stay. Null and empty texts pass; a null source counts as one owner."""
    return secrets.redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the ids of every text that is left; none of null and empty texts."""
    return bpe.encode(docs)


STAGES = [
    ("language ID", known_language),
    ("near-duplicates", without_near_duplicates),
    ("benchmark decontamination", without_benchmarks),
    ("secret scan", without_secrets),
    ("byte-level BPE", encoded),
]

#: Compressed sizes, signatures and merges have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again, and deleted when the next are there."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/quillmill-pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.option("compression", "zstd").parquet(f"{base}/{k}")
        before, docs = docs, spark.read.schema(out.schema).parquet(f"{base}/{k}")
        docs.stored_at = f"{base}/{k}"
        if k:
            forget(before)
    return docs

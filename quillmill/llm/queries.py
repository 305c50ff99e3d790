"""One thin query for each operator, over its whole table, and the SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import bpe, decontaminate, jpeg, langid, lattice, neardup, secrets, sql, substrings, token_counts, toxicity
from quillmill.llm.common import remainder, table


def op1_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.digest(table(spark, sf_dir, "documents"))


def op2_compression_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, remainder("doc_id", 5) != 0)
    found = langid.classify(docs, model)
    return found.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op3_segment_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 4) != 2)
    found = toxicity.scan(docs, model)
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted", "passages")


def op4_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = lattice.with_hold_out(table(spark, sf_dir, "documents"), remainder("doc_id", 7) == 2)
    return lattice.score(docs, lattice.fit(docs))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op7_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.suffix_sums(token_counts.histogram(table(spark, sf_dir, "documents")))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    """The operators whose whole result SQL can express on the tables as they are; the others are tested by brute force."""
    return {"op5_decontaminate": sql.DECONTAMINATE, "op6_secret_ownership": sql.SECRETS, "op7_superminhash": sql.NEAR_DUPLICATES, "op10_substring_dedup": sql.SUBSTRINGS}

"""Exact length histogram: documents by encoded length, and suffix sums that answer for every context limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.llm import bpe
from quillmill.llm.common import stored

#: Lengths that share a block of the two-level suffix sums.
BLOCK = 1024


def histogram(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """length, n_docs: how many documents encode to so many ids. Null and empty texts have length 0; repeated rows count each.

    The histogram is stored, so that texts are encoded once however many answers are asked of it. An empty table gives
    no rows; ids may be null and of any type, they are not used.
    """
    lengths = bpe.encode(df, id_col, text_col, vocabulary, pattern, ids=False)
    return stored(lengths.groupBy(F.col("n_tokens").alias("length")).agg(F.count(F.lit(1)).alias("n_docs")), "token-histogram")


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length of the histogram, taken as a context limit, the answers over all documents.

    docs_at_least and tokens_at_least: the suffix sums. docs_total, tokens_total: all. truncated_total: tokens left if
    every document is cut to the limit. cut_docs: documents that lose tokens. rank_at_most: documents of at most this
    length, from which quantiles follow. The sums run in blocks of lengths, and over one row a block, so that no task
    gets the whole histogram. An empty histogram gives no rows.
    """
    block = F.floor(F.col("length") / BLOCK)
    h = hist.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("tokens"), block.alias("block"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    above = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    blocks = blocks.select(
        "block",
        zero(F.sum("block_docs").over(above)).alias("docs_above"),
        zero(F.sum("block_tokens").over(above)).alias("tokens_above"),
        F.sum("block_docs").over(every).alias("docs_total"),
        F.sum("block_tokens").over(every).alias("tokens_total"),
    )
    within = Window.partitionBy("block").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = h.join(blocks, "block").select(
        "length",
        "n_docs",
        (F.sum("n_docs").over(within) + F.col("docs_above")).alias("docs_at_least"),
        (F.sum("tokens").over(within) + F.col("tokens_above")).alias("tokens_at_least"),
        "docs_total",
        "tokens_total",
    )
    return s.select(
        "*",
        (F.col("tokens_total") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")).alias("truncated_total"),
        (F.col("docs_at_least") - F.col("n_docs")).alias("cut_docs"),
        (F.col("docs_total") - F.col("docs_at_least") + F.col("n_docs")).alias("rank_at_most"),
    )


def quantiles(sums: DataFrame, points: list[float]) -> DataFrame:
    """q, length: the nearest-rank quantile of the encoded lengths; none of an empty histogram."""
    asked = F.explode(F.array(*[F.lit(float(q)) for q in points]))
    hit = sums.withColumn("q", asked).where(F.col("rank_at_most") >= F.greatest(F.lit(1.0), F.ceil(F.col("q") * F.col("docs_total"))))
    return hit.groupBy("q").agg(F.min("length").alias("length"))


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """context_limit, docs, truncated_total, cut_docs for any limits, also such as no document has."""
    asked = F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits]))
    over = F.col("length") > F.col("context_limit")
    return sums.withColumn("context_limit", asked).groupBy("context_limit").agg(
        F.sum("n_docs").alias("docs"),
        F.sum(F.least("length", "context_limit") * F.col("n_docs")).alias("truncated_total"),
        F.sum(F.when(over, F.col("n_docs")).otherwise(0)).alias("cut_docs"),
    )

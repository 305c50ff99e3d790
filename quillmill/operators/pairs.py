"""Occurrences of (current, candidate) pairs: cleaning, deduplication, scoring joins, summaries, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions import rules
from quillmill.operators.ordered import quantiles
from quillmill.functions.text import composite_key


def occurrences(df: DataFrame, reason: Column) -> DataFrame:
    """Adds pair_id, noop, valid, reason to rows (source_id, current, candidate, ...): one row stays one row."""
    return df.withColumn("pair_id", composite_key(F.col("source_id"), F.col("current"), F.col("candidate"))).withColumn("noop", rules.is_noop(F.col("current"), F.col("candidate"))).withColumn("reason", F.coalesce(reason, F.lit("valid"))).withColumn("valid", F.col("reason") == "valid")


def distinct_pairs(occ: DataFrame, order: list[str]) -> DataFrame:
    """Valid changed pairs, each as it first occurs in the given order; an id that comes again, in another split too, adds nothing.

    min_by needs one partial aggregation and no sort; order columns must tell occurrences apart.
    """
    rest = [c for c in occ.columns if c not in ("pair_id", "valid", "noop", "reason")]
    first = occ.where(F.col("valid") & ~F.col("noop")).groupBy("pair_id").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return first.select("pair_id", "row.*")


def summary(occ: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: raw, valid, no-op and valid changed occurrences, distinct pairs, duplicates, source clusters, labels."""
    raw = occ.agg(
        F.count(F.lit(1)).alias("raw_pairs"),
        F.count_if("valid").alias("valid_pairs"),
        F.count_if("noop").alias("no_op_pairs"),
        F.count_if(F.col("valid") & ~F.col("noop")).alias("valid_changed"),
    )
    unique = pairs.agg(
        F.count(F.lit(1)).alias("unique_changed"),
        F.count_distinct("source_id").alias("source_clusters"),
        F.count_if(F.col("label") == "Accept").alias("accepts"),
        F.count_if(F.col("label") == "Reject").alias("rejects"),
        F.count_if(F.col("label").isNull()).alias("unscored"),
    )
    both = raw.crossJoin(F.broadcast(unique))  # one row each
    labelled = F.greatest(F.lit(1), F.col("accepts") + F.col("rejects"))
    return both.withColumn("duplicates", F.col("valid_changed") - F.col("unique_changed")).withColumn("accept_ratio", F.col("accepts") / labelled)


def by_generator(occ: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per generator: counts, distinct changed pairs, distinct labelled pairs by label, their ratio."""
    o = occ.join(pairs.select("pair_id", "label"), "pair_id", "left")
    good = F.col("valid") & ~F.col("noop")
    out = o.groupBy("generator").agg(
        F.count(F.lit(1)).alias("raw_pairs"),
        F.count_if("valid").alias("valid_pairs"),
        F.count_if("noop").alias("no_op_pairs"),
        F.count_distinct(F.when(good, F.col("pair_id"))).alias("unique_changed"),
        F.count_distinct(F.when(F.col("label") == "Accept", F.col("pair_id"))).alias("accepts"),
        F.count_distinct(F.when(F.col("label") == "Reject", F.col("pair_id"))).alias("rejects"),
    )
    return out.withColumn("accept_ratio", F.col("accepts") / F.greatest(F.lit(1), F.col("accepts") + F.col("rejects")))


def generator_quantiles(occ: DataFrame, pairs: DataFrame, points: list[float]) -> DataFrame:
    """Per generator: quantiles (linear) of the deltas of its distinct pairs, whatever their occurrences' validity."""
    d = pairs.select("pair_id", "delta").join(occ.select("pair_id", "generator"), "pair_id").where("delta is not null").distinct()
    return quantiles(d, ["generator"], "delta", {f"q{round(p * 100):02d}": p for p in points})


def by_bucket(occ: DataFrame, pairs: DataFrame, bucket: str) -> DataFrame:
    """Per bucket: occurrences, and of these with a scored pair by label."""
    o = occ.join(pairs.select("pair_id", "label"), "pair_id", "left")
    return o.groupBy(bucket).agg(F.count(F.lit(1)).alias("raw_occurrences"), F.count_if(F.col("label") == "Accept").alias("accepts"), F.count_if(F.col("label") == "Reject").alias("rejects"))


def reasons(occ: DataFrame) -> DataFrame:
    return occ.where(~F.col("valid")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def export(occ: DataFrame, pairs: DataFrame, provenance: Column, order: list[str]) -> DataFrame:
    """Each pair with the provenance of all its occurrences, in order: one join and one grouping instead of a query a pair."""
    o = occ.select("pair_id", F.struct(*order, provenance.alias("provenance")).alias("p"))
    told = o.groupBy("pair_id").agg(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["provenance"]).alias("provenance"))
    return pairs.join(told, "pair_id")


def unscored(pairs: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct keys that the score cache lacks: what an external scorer has to be asked."""
    return pairs.select("key").distinct().join(cache, "key", "left_anti")


def scored(pairs: DataFrame, cache: DataFrame) -> DataFrame:
    return pairs.join(cache.select("key", "score"), "key", "left")


def with_label(pairs: DataFrame, epsilon: float = 0.0) -> DataFrame:
    return pairs.withColumn("label", rules.label(F.col("delta"), epsilon))


def require_changed(pairs: DataFrame) -> DataFrame:
    """The rows, or an error at the first no-op among them."""
    return pairs.where(F.when(rules.is_noop(F.col("current"), F.col("candidate")), F.raise_error(F.lit("no-op pair"))).otherwise(True))


def epsilon_grid(pairs: DataFrame, grid: DataFrame) -> DataFrame:
    """Label counts for each margin of a grid, which is a handful of rows."""
    return pairs.crossJoin(F.broadcast(grid)).groupBy("epsilon").agg(F.count_if(F.col("delta") > F.col("epsilon")).alias("accepts"), F.count_if(F.col("delta") < -F.col("epsilon")).alias("worse"), F.count_if(F.abs("delta") <= F.col("epsilon")).alias("ties"))


def delta_histogram(df: DataFrame, edges: list[float], zero: float = 1e-8) -> DataFrame:
    """Rows by size of |delta| and by sign."""
    size = F.lit(f"ge_{edges[-1]:g}")
    for e in reversed(edges):
        size = F.when(F.abs("delta") < e, F.lit(f"lt_{e:g}")).otherwise(size)
    sign = F.when(F.col("delta") > zero, "up").when(F.col("delta") < -zero, "down").otherwise("zero")
    return df.groupBy(size.alias("bin"), sign.alias("sign")).agg(F.count(F.lit(1)).alias("n"))


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key, by an explicit order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")

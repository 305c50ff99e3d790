"""Joins with a contract: defaults, bijections, pairings, availability in time, merges of edited tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_default(left: DataFrame, right: DataFrame, key: str, column: str, default: object) -> DataFrame:
    return left.join(right.select(key, column), key, "left").fillna({column: default})


def paired(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """key, a, b, side of a full join: both, only_a, only_b."""
    j = a.select(key, F.col(value).alias("a"), F.lit(1).alias("__a")).join(b.select(key, F.col(value).alias("b"), F.lit(1).alias("__b")), key, "full")
    side = F.when(F.col("__b").isNull(), "only_a").when(F.col("__a").isNull(), "only_b").otherwise("both")
    return j.select(key, "a", "b", side.alias("side"))


def control_of(runs: DataFrame, by: list[str], tag: str) -> DataFrame:
    """The control run of each group: the one without a tag, else the only one; groups with several tagged ones have none."""
    w = Window.partitionBy(*by)
    r = runs.withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__plain", F.count_if(F.col(tag) == "").over(w))
    return r.where(((F.col("__plain") > 0) & (F.col(tag) == "")) | ((F.col("__plain") == 0) & (F.col("__n") == 1))).drop("__n", "__plain")


def bijection(predictions: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Both sides joined; an error if a key is missing on a side or comes twice."""
    p = predictions.groupBy(key).agg(F.first("decision").alias("decision"), F.count(F.lit(1)).alias("__n"))
    j = labels.join(p, key, "full")
    broken = F.col("decision").isNull() | F.col("label").isNull() | (F.col("__n") > 1)
    return j.where(F.when(broken, F.raise_error(F.concat(F.lit("not one to one: "), F.col(key).cast("string")))).otherwise(True)).drop("__n")


def aligned(a: DataFrame, b: DataFrame, key: str, same: list[str]) -> DataFrame:
    """Joined on the key; an error where columns that must be equal aren't."""
    j = a.join(b.select(key, *[F.col(c).alias(f"__{c}") for c in same], *[c for c in b.columns if c not in (key, *same)]), key)
    off = F.lit(False)
    for c in same:
        off = off | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    return j.where(F.when(off, F.raise_error(F.concat(F.lit("differs at "), F.col(key).cast("string")))).otherwise(True)).drop(*[f"__{c}" for c in same])


def born_before(retrieved: DataFrame, births: DataFrame, unit: str) -> DataFrame:
    """Adds ok: whether the unit was born in an earlier batch than that of its retrieval; unborn ones are not ok."""
    j = retrieved.join(births.select(unit, "birth_batch"), unit, "left")
    return j.withColumn("ok", F.coalesce(F.col("birth_batch") < F.col("batch"), F.lit(False)))


def available(rounds: DataFrame, by: str, order: str) -> DataFrame:
    """Adds missing: retrieved ids that neither the initial set nor earlier rounds had admitted. Rounds of one run are few."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    had = F.coalesce(F.flatten(F.collect_list("admitted").over(w)), F.array().cast("array<string>"))
    return rounds.withColumn("missing", F.array_except("retrieved", F.concat(F.col("initial"), had)))


def all_pairs(candidates: DataFrame, group: str, index: str, *columns: str) -> DataFrame:
    """Pairs i < j within a group of a bounded number of candidates (a sample's generations)."""
    a = candidates.select(group, F.col(index).alias("i"), *[F.col(c).alias(f"{c}_i") for c in columns])
    b = candidates.select(group, F.col(index).alias("j"), *[F.col(c).alias(f"{c}_j") for c in columns])
    return a.join(b, group).where("i < j")


def completeness(found: DataFrame, grid: list[DataFrame], keys: list[str], expected: Column) -> DataFrame:
    """Every cell of a grid of settings with n, expected and complete; the grid is the product of small tables."""
    cells = grid[0]
    for g in grid[1:]:
        cells = cells.crossJoin(F.broadcast(g))
    n = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return cells.join(n, keys, "left").fillna(0, ["n"]).withColumn("expected", expected).withColumn("complete", F.col("n") >= F.col("expected"))


def agreement(a: DataFrame, b: DataFrame, key: str, value: str, resolved: list[str]) -> DataFrame:
    """One row: share of equal values over all shared keys, and over those that both resolve."""
    j = a.select(key, F.col(value).alias("x")).join(b.select(key, F.col(value).alias("y")), key)
    both = F.col("x").isin(resolved) & F.col("y").isin(resolved)
    eq = (F.col("x") == F.col("y")).cast("double")
    return j.agg(F.count(F.lit(1)).alias("n"), F.avg(eq).alias("agree"), F.count_if(both).alias("n_resolved"), F.avg(F.when(both, eq)).alias("agree_resolved"))


def merge_edits(own: DataFrame, edited: DataFrame, key: str, running: str, columns: list[str]) -> DataFrame:
    """A table after outside edits: new rows come in, edits are taken unless the row is running, vanished rows go unless running."""
    o = own.select(key, running, *columns).withColumn("__own", F.lit(True))
    e = edited.select(key, *[F.col(c).alias(f"__{c}") for c in columns]).withColumn("__edit", F.lit(True))
    j = o.join(e, key, "full").withColumn(running, F.coalesce(running, F.lit(False)))
    stays = F.col("__edit").isNotNull() | F.col(running)
    keep = F.col("__own").isNotNull() & F.col(running)
    return j.where(stays).select(key, running, *[F.when(keep | F.col("__edit").isNull(), F.col(c)).otherwise(F.col(f"__{c}")).alias(c) for c in columns])


def keep_fullest(runs: DataFrame, by: list[str], n: str, path: str) -> DataFrame:
    """Of duplicate runs the one with most rows, then the first path."""
    rest = [c for c in runs.columns if c not in by]
    return runs.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(-F.col(n), F.col(path))).alias("r")).select(*by, "r.*")


def shared_keys(rows: DataFrame, group: str, key: str) -> DataFrame:
    """The rows whose key every group has."""
    n = rows.agg(F.count_distinct(group).alias("__n"))
    each = rows.groupBy(key).agg(F.count_distinct(group).alias("__of"))
    return rows.join(each.crossJoin(F.broadcast(n)).where("__of = __n").select(key), key, "left_semi")


def modal_signature(rows: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """group, signature, modal: a hash over the values in order of the keys, and whether it is the most frequent one.

    Values are hashed first, so a group's list holds a short string a key.
    """
    short = rows.select(group, F.struct(key, F.sha2(F.col(value).cast("string"), 256).alias("h")).alias("x"))
    s = short.groupBy(group).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda v: v["h"]), ","), 256).alias("signature"))
    counted = s.groupBy("signature").agg(F.count(F.lit(1)).alias("n"))
    top = counted.agg(F.max_by("signature", F.struct("n", "signature")).alias("top"))
    return s.crossJoin(F.broadcast(top)).select(group, "signature", (F.col("signature") == F.col("top")).alias("modal"))

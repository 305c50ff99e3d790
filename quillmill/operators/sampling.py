"""Deterministic samples and orders: by hash, by stratum, evenly spread, by budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.text import composite_key
from quillmill.operators.ordered import placed


def hash_order(df: DataFrame, salt: str, id_col: str, n: int | None = None) -> DataFrame:
    """Rows in the order of the salted hash of their id, the first n of them."""
    out = df.orderBy(composite_key(F.lit(salt), F.col(id_col)), id_col)
    return out if n is None else out.limit(n)


def one_per_source(df: DataFrame, salt: str, source: str, id_col: str) -> DataFrame:
    """Of each source the row whose salted hash is least."""
    rest = [c for c in df.columns if c != source]
    return df.groupBy(source).agg(F.min_by(F.struct(*rest), F.struct(composite_key(F.lit(salt), F.col(id_col)), F.col(id_col))).alias("r")).select(source, "r.*")


def per_group(df: DataFrame, group: str, salt: str, id_col: str, n: int) -> DataFrame:
    """At most n rows of each group, by hash."""
    w = Window.partitionBy(group).orderBy(composite_key(F.lit(salt), F.col(id_col)), id_col)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def round_robin(df: DataFrame, stratum: str, salt: str, id_col: str, n: int) -> DataFrame:
    """n rows: the first of each stratum by hash, then the second of each, and so on."""
    w = Window.partitionBy(stratum).orderBy(composite_key(F.lit(salt), F.col(id_col)), id_col)
    return df.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= n).orderBy("turn", stratum).limit(n)


def spread(n: Column, k: int) -> Column:
    """k places spread evenly over 0..n - 1, rounded half to even; all of fewer."""
    even = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(max(k - 1, 0))), lambda i: F.rint(i * (n - 1) / F.lit(max(k - 1, 1))).cast("int")))
    return F.when((F.lit(k) <= 0) | (n <= 0), F.array().cast("array<int>")).when(n <= k, F.sequence(F.lit(0), n.cast("int") - 1)).when(F.lit(k) == 1, F.array(F.floor(n / 2).cast("int"))).otherwise(even)


def allocate(cells: DataFrame, order: str, avail: str, budget: int) -> DataFrame:
    """Adds share: an even split of a budget over the cells that have data, what one can't use going to the others.

    Water filling in closed form: in order of what is available, a cell gets all it has as long as that is below an even
    share of what is left; the others part the rest, those with most to spare first. cells is a table of settings, small.
    """
    w = Window.orderBy(avail, order)
    some = cells.where(F.col(avail) > 0).withColumn("rn", F.row_number().over(w)).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy()))
    before = F.coalesce(F.sum(avail).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    some = some.withColumn("level", (F.lit(budget) - before) / (F.col("m") - F.col("rn") + 1))
    full = some.withColumn("fits", F.col(avail) <= F.floor("level"))
    # the first cell that doesn't fit sets the level for itself and all behind it
    first = F.min(F.when(~F.col("fits"), F.col("rn"))).over(Window.partitionBy())
    at = F.max(F.when(F.col("rn") == first, F.col("level"))).over(Window.partitionBy())
    marked = full.withColumn("first", first).withColumn("at", at).withColumn("open", F.coalesce(F.col("rn") >= F.col("first"), F.lit(False)))
    rest = F.round((F.col("at") - F.floor("at")) * (F.col("m") - F.col("first") + 1)).cast("int")
    turn = F.row_number().over(Window.partitionBy("open").orderBy(F.col(avail).desc(), order))
    share = F.when(F.col("open"), F.floor("at") + (turn <= rest).cast("int")).otherwise(F.col(avail))
    out = marked.withColumn("share", F.greatest(F.lit(0), share).cast("long")).select(order, "share")
    return cells.join(out, order, "left").fillna(0, ["share"])


def top_share(df: DataFrame, score: str, id_col: str, share: float) -> DataFrame:
    """The rows of largest score, ids breaking ties upwards: the share of all rows, rounded up."""
    n = df.agg(F.ceil(F.lit(share) * F.count(F.lit(1))).alias("__n"))
    return placed(df, [F.col(score).desc(), F.col(id_col)], "__at").crossJoin(F.broadcast(n)).where("__at < __n").drop("__at", "__n")


def in_batches(df: DataFrame, order: list[str], size: int, by: list[str] | None = None) -> DataFrame:
    """Adds batch: position in order, over all rows or by groups, div size."""
    return placed(df, [F.col(c) for c in order], "batch", by).withColumn("batch", F.floor(F.col("batch") / size).cast("long"))


def permutations(df: DataFrame, id_col: str, orders: int, seed: int) -> DataFrame:
    """Adds order and position: so many distinct orders of the same rows, each by its own hash."""
    each = df.withColumn("order", F.explode(F.sequence(F.lit(0), F.lit(orders - 1))))
    return placed(each, [composite_key(F.lit(seed), F.col("order"), F.col(id_col)), F.col(id_col)], "position", ["order"])

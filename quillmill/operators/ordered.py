"""Places and running totals over all rows in one order, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.sources.scratch import stored


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds to each row the sums over all rows up to it, itself included; no row's order may equal another's.

    Ranges of the order are the tasks. Each range adds up its own rows; one row a range goes through a small window that
    says what lies before it. The ranges are stored first, so that a task that runs again meets the same rows in its range.
    """
    ranged = stored(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranged")
    each = Window.partitionBy("__range")
    until = each.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("__range").agg(*[F.sum(c).alias(f"__of_{name}") for name, c in sums.items()])
    offsets = totals.select("__range", *[F.coalesce(F.sum(f"__of_{name}").over(before), F.lit(0)).alias(f"__before_{name}") for name in sums])
    out = ranged.withColumns({name: F.sum(c).over(until) for name, c in sums.items()}).join(F.broadcast(offsets), "__range")
    return out.withColumns({name: F.col(name) + F.col(f"__before_{name}") for name in sums}).select(*df.columns, *sums)


def within(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds running sums, none of a negative number, that start anew in each group; a large group is the work of many tasks.

    The groups follow each other in one order over all rows; a group starts at the least that stands before one of its rows.
    """
    if not by:
        return running(df, order, sums)
    rows = running(df, [*map(F.col, by), *order], sums).withColumns({f"__own_{name}": c for name, c in sums.items()})
    starts = rows.groupBy(*by).agg(*[F.min(F.col(name) - F.col(f"__own_{name}")).alias(f"__start_{name}") for name in sums])
    return _beside(rows, starts, by).select(*df.columns, *[(F.col(name) - F.col(f"__start_{name}")).alias(name) for name in sums])


def _beside(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """The rows with what a table says of their group; null is a group."""
    named = groups.withColumnsRenamed({c: f"__by_{c}" for c in by})
    return rows.join(named, [F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by]).drop(*[f"__by_{c}" for c in by])


def placed(df: DataFrame, order: list[Column], name: str, by: list[str] | None = None) -> DataFrame:
    """Adds each row's place in the order, from 0, over all rows or in its group."""
    return within(df, by or [], order, {name: F.lit(1).cast("long")}).withColumn(name, F.col(name) - 1)


def quantiles(df: DataFrame, by: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """by... and exact quantiles (linear between neighbours) of non-null values under the names given."""
    places = {name: F.lit(float(p)) * (F.col("__all") - 1) for name, p in points.items()}
    ends = {f"__{end}_{name}": fn(c) for name, c in places.items() for end, fn in (("low", F.floor), ("high", F.ceil))}
    between = lambda name, c: F.col(f"__low_{name}") + (F.col(f"__high_{name}") - F.col(f"__low_{name}")) * (c - F.floor(c))
    return at_places(df, by, value, ends).select(*by, *[between(name, c).alias(name) for name, c in places.items()])


def at_places(df: DataFrame, by: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """by..., __all (non-null values) and the values at places, from 0, of each group's sorted values; places may name __all."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    sizes = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("__all"))
    rows = _beside(within(counts, by, [F.col(value)], {"__upto": F.col("__n")}), sizes, by)
    here = lambda place: F.max(F.when((F.col("__upto") - F.col("__n") <= place) & (place < F.col("__upto")), F.col(value)))
    return rows.groupBy(*by, "__all").agg(*[here(c).alias(name) for name, c in places.items()])

"""Keeping splits apart: key overlap, blocklists, quarantine, distinct merges and audits of exact sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exclude(df: DataFrame, forbidden: DataFrame, key: str) -> DataFrame:
    """Rows whose key no forbidden row has; a null key matches nothing and stays."""
    return df.join(forbidden.select(key).distinct(), key, "left_anti")


def exclude_either(df: DataFrame, row_id: str, keys: list[str], forbidden: DataFrame) -> DataFrame:
    """Rows none of whose keys is forbidden: keys exploded, hit rows found once, then one anti-join."""
    hit = df.select(row_id, F.explode(F.array(*keys)).alias("key")).join(forbidden.select("key").distinct(), "key", "left_semi").select(row_id).distinct()
    return df.join(hit, row_id, "left_anti")


def blocklist(*sources: DataFrame) -> DataFrame:
    """Distinct keys of all sources."""
    return reduce(DataFrame.union, [s.select("key") for s in sources]).distinct()


def split_leaks(df: DataFrame, key: str, split: str) -> DataFrame:
    """Keys in more than one split, with how many; no self-join."""
    return df.groupBy(key).agg(F.count_distinct(split).alias("n_splits"), F.count(F.lit(1)).alias("n_rows")).where("n_splits > 1")


def split_crosstab(a: DataFrame, b: DataFrame, key: str, split: str) -> DataFrame:
    """From which split of a to which of b keys go, and how many rows of a."""
    right = b.select(key, F.col(split).alias("to_split")).distinct()
    return a.join(right, key).groupBy(F.col(split).alias("from_split"), "to_split").agg(F.count(F.lit(1)).alias("n"))


def key_frequency(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(F.explode(F.array(*columns)).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def in_every_group(df: DataFrame, key: str, group: str) -> DataFrame:
    """Keys that all groups have."""
    groups = df.agg(F.count_distinct(group).alias("n_groups"))
    each = df.groupBy(key).agg(F.count_distinct(group).alias("n"))
    return each.crossJoin(F.broadcast(groups)).where("n = n_groups").select(key)


def set_sizes(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: in both, only in a, only in b."""
    full = a.select(key).distinct().withColumn("in_a", F.lit(1)).join(b.select(key).distinct().withColumn("in_b", F.lit(1)), key, "full")
    return full.agg(F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).alias("both"), F.count_if(F.col("in_b").isNull()).alias("only_a"), F.count_if(F.col("in_a").isNull()).alias("only_b"))


def assert_same_set(a: DataFrame, b: DataFrame, key: str) -> None:
    """An error unless both have the same distinct keys."""
    if not a.select(key).exceptAll(b.select(key)).isEmpty() or not b.select(key).exceptAll(a.select(key)).isEmpty():
        raise ValueError(f"{key}: the sets differ")


def merge_records(df: DataFrame, digest: str, order: str, provenance: str) -> DataFrame:
    """One row a digest: the first record in order, the number of records, all provenances in order."""
    rest = [c for c in df.columns if c not in (digest, provenance)]
    return df.groupBy(digest).agg(F.min_by(F.struct(*rest), F.col(order)).alias("row"), F.count(F.lit(1)).alias("n_records"), F.transform(F.array_sort(F.collect_list(F.struct(order, provenance))), lambda x: x[provenance]).alias("provenance")).select(digest, "row.*", "n_records", "provenance")


def conflicting_keys(df: DataFrame, key: str, value: str, tolerance: float = 1e-6) -> DataFrame:
    """Keys whose values differ by more than the tolerance."""
    return df.groupBy(key).agg((F.max(value) - F.min(value)).alias("spread")).where(F.col("spread") > tolerance)


def quarantine(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_anti")


def cascade(df: DataFrame, reasons: list[tuple[str, Column]]) -> DataFrame:
    """Adds reason: the first that holds, null for rows that stay."""
    out = F.lit(None).cast("string")
    for name, condition in reversed(reasons):
        out = F.when(condition, F.lit(name)).otherwise(out)
    return df.withColumn("reason", out)


def containment(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) where the item's text stands in the document's, for items of at least four words.

    The inner words of an item that is contained stand in the document as whole words, so an equi-join on its second and
    third word finds all candidates, each then checked once; not every pair of texts is compared.
    """
    words = lambda c: F.split(F.trim(c), r"\s+")
    inner = items.select("item_id", F.col("text").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") >= 4)
    inner = inner.select("item_id", "item", F.xxhash64(F.get("w", F.lit(1)), F.get("w", F.lit(2))).alias("pair"))
    rest = F.greatest(F.size("w") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("w", 1, rest), F.slice("w", 2, rest), lambda a, b: F.xxhash64(a, b))
    placed = docs.select("doc_id", words(F.col("text")).alias("w")).select("doc_id", F.explode(F.array_distinct(pairs)).alias("pair"))
    near = placed.join(inner.select("pair", "item_id"), "pair").select("doc_id", "item_id").distinct()
    return near.join(docs.select("doc_id", "text"), "doc_id").join(inner.select("item_id", "item"), "item_id").where(F.contains("text", F.col("item"))).select("doc_id", "item_id")


def forbidden_phrases(df: DataFrame, text: str, phrases: list[str]) -> DataFrame:
    """Rows that hold a phrase, which should not have leaked into them."""
    return df.where(F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(F.col(text), p)))

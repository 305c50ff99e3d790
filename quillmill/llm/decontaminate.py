"""Benchmark decontamination by a broadcast hash set of normalised n-grams, in DataFrame functions only.

A benchmark item's windows go into a table keyed by the hash of a pair of neighbouring words, the anchor: the pair that
is longest in letters, so that few other texts hold it. Documents' words are exploded next to their array; a pair that
hits the table is verified by comparing the whole window. The table is broadcast while its bytes are few enough. Beyond
that the documents' pairs are shuffled, each with its document's mark and place alone, and the texts are fetched again for
those documents that a pair led to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import row_mark

#: Words in a window.
WINDOW = 10
#: Bytes up to which the table of benchmark windows is broadcast, with all item ids of each.
BROADCAST_BYTES = 64 << 20

#: What parts words: ASCII other than letters and digits.
PART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, A-Z folded; none of null or empty text."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), PART), lambda w: w != "")


def _pair(words_: Column, at: Column) -> Column:
    """Hash of the words at a place and behind it; a lone word's own."""
    return F.xxhash64(F.get(words_, at), F.get(words_, at + 1))


def ngrams(bench: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """anchor, lead (words before the anchor), size, gram (the window's words as an array), items (ids): one row a distinct window.

    An item of fewer words than a window, but not none, is one window. Null and empty items have none.
    """
    items = bench.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(window))
    grams = items.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.slice(F.col("w"), i, size))).alias("gram"))
    grams = grams.groupBy("gram").agg(F.collect_set("item_id").alias("items")).withColumn("size", F.size("gram"))
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.greatest(F.col("size") - 2, F.lit(0))), lambda i: F.struct((F.length(F.get("gram", i)) + F.coalesce(F.length(F.get("gram", i + 1)), F.lit(0))).alias("letters"), (-i).alias("back"))))
    return grams.withColumn("lead", -best["back"]).withColumn("anchor", F.when(F.col("size") > 1, _pair(F.col("gram"), F.col("lead"))).otherwise(F.xxhash64(F.get("gram", F.lit(0))))).select("anchor", "lead", "size", "gram", "items")


def _bytes(grams: DataFrame) -> int:
    """About what the table takes in memory: words with their offsets, ids, the rest of the row."""
    words_ = F.aggregate("gram", F.lit(0).cast("long"), lambda n, w: n + F.octet_length(w) + 24)
    ids = F.aggregate("items", F.lit(0).cast("long"), lambda n, x: n + F.coalesce(F.octet_length(x.cast("string")), F.lit(0)) + 24)
    return grams.agg(F.sum(words_ + ids + 64)).first()[0] or 0


def occurrences(docs: DataFrame, grams: DataFrame, mark: str, text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """mark, start (of the window, from 0), size and items: every place of a document where a window stands, verified word by word."""
    shipped = _bytes(grams) <= broadcast_bytes
    tokens = docs.select(mark, words(F.col(text_col)).alias("w"))
    placed = tokens.select(mark, "w", F.posexplode("w").alias("at", "word"))
    pair = _pair(F.col("w"), F.col("at"))
    lone = not shipped or not grams.where(F.col("size") == 1).isEmpty()
    hashed = placed.withColumn("anchor", F.explode(F.array(pair, F.xxhash64("word"))) if lone else pair)
    start = F.col("at") - F.col("lead")
    if shipped:
        met = hashed.join(F.broadcast(grams), "anchor").where(start >= 0).withColumn("start", start)
    else:
        led = hashed.select(mark, "at", "anchor").join(grams, "anchor").where(start >= 0).select(mark, start.alias("start"), "size", "gram", "items")
        met = led.join(docs.join(led.select(mark).distinct(), mark, "left_semi").dropDuplicates([mark]).select(mark, words(F.col(text_col)).alias("w")), mark)
    return met.where(F.slice(F.col("w"), F.col("start") + 1, F.col("size")) == F.col("gram")).select(mark, "start", "size", "items")


def report(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids, sorted as strings), places (hit words from 0, sorted), one row for each document row.

    A word is hit if any occurrence of a window covers it. A document is known by its id and text: repeated rows get the
    same values, rows that share an id but not the text their own. Ids may be of any type and null. Null and empty texts have
    no words and no hits. An empty benchmark hits nothing; empty documents give no rows.
    """
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("mark", row_mark("doc_id", "text"))
    hits = occurrences(keyed, ngrams(bench, window=window), "mark", broadcast_bytes=broadcast_bytes)
    spans = F.flatten(F.collect_set(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)))
    per = hits.groupBy("mark").agg(F.array_sort(F.array_distinct(spans)).alias("places"), F.array_sort(F.array_distinct(F.transform(F.flatten(F.collect_set("items")), lambda x: x.cast("string")))).alias("items"))
    base = keyed.select("doc_id", "mark", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = base.join(per, "mark", "left")
    places = F.coalesce("places", F.array().cast("array<int>"))
    return out.select("doc_id", "n_words", F.size(places).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), places.alias("places"))


def clean(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, max_share: float = 0.5, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of docs without what the benchmark holds: documents hit in over ``max_share`` of their words go, of the others the hit spans.

    A row without hits passes as it is, in all columns. A removed span takes its words and what parts them from the word
    before; what stands before the first and behind the last word stays. ``n_chars``, if there, is counted anew. Repeated
    rows stay and fare alike; null and empty texts pass; ids may be of any type and null.
    """
    order = docs.columns
    keyed = docs.withColumn("__mark", row_mark(id_col, text_col))
    hits = occurrences(keyed.select("__mark", F.col(text_col).alias("text")), ngrams(bench, window=window), "__mark", broadcast_bytes=broadcast_bytes)
    per = hits.groupBy("__mark").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1))))).alias("__places"))
    joined = keyed.join(per, "__mark", "left")
    text = F.col(text_col)
    whole, parts = F.split(text, PART), F.regexp_extract_all(text, F.lit(f"({PART})"), 1)
    # a unit is a word with what parts it from the one before; unit 0 is empty if the text begins with what parts words
    units = F.zip_with(F.concat(F.array(F.lit("")), parts), whole, lambda p, w: F.concat(F.coalesce(p, F.lit("")), F.coalesce(w, F.lit(""))))
    lead = (F.get(whole, F.lit(0)) == "").cast("int")
    # runs of kept units: (first, behind), from the sorted hit places
    gaps = F.aggregate(
        F.col("__places"),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first:int,behind:int>>").alias("out")),
        lambda acc, x: F.struct((x + lead + 1).alias("at"), F.when(x + lead > acc["at"], F.concat(acc["out"], F.array(F.struct(acc["at"].alias("first"), (x + lead).alias("behind"))))).otherwise(acc["out"]).alias("out")),
        lambda acc: F.concat(acc["out"], F.array(F.struct(acc["at"].alias("first"), F.size(units).alias("behind")))),
    )
    kept = F.array_join(F.flatten(F.transform(gaps, lambda g: F.slice(F.col("__units"), g["first"] + 1, F.greatest(g["behind"] - g["first"], F.lit(0))))), "")
    hit = F.col("__places").isNotNull()
    share = F.size("__places") / F.size(words(text))
    left = joined.where(~hit | (share <= max_share)).withColumn("__units", F.when(hit, units))
    out = left.withColumn(text_col, F.when(hit, kept).otherwise(text))
    if "n_chars" in order:
        out = out.withColumn("n_chars", F.when(hit, F.length(text_col).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*order)

"""Exact removal of passages that repeat: level-wise doubling over windows of words.

Level 1 looks at short windows, of a quarter of the target: not at all of them, but at the one of least hash in each
target window. Two equal target windows choose the same short window, so none is lost, and only one place in some
fourteen is shuffled. Level 2 extends the places whose short window repeats to twice the length, both to the right and to
the left; every target window holds one of the two. Level 3 takes the target windows around the places that survive, and
what repeats there is removed. Each level counts hashes with partial sums first and joins the repeated ones back. The hashes
of levels 1 and 2 only say where to look; level 3 compares windows by 128 bits of BLAKE2b over their very words.

Equal texts, by 128 bits of MD5, are one content: beside the windows, their number says that all of it repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import arrow_map, column, digest, forget, stored, texts
from quillmill.llm.hashing import mix, run_hashes, word_hashes

#: Words in a window.
WINDOW = 35
_LOW = 20


def lengths(window: int) -> tuple[int, int]:
    """Of the windows of levels 1 and 2: each at least half of the next level's."""
    second = (window + 1) // 2
    return (second + 1) // 2, second


def _seeds(words: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The starts of all target windows, the place of the short window that each chooses, and all short windows' hashes."""
    short = lengths(window)[0]
    span = window - short + 1
    ends = np.repeat(offsets[1:], np.diff(offsets))
    starts = np.flatnonzero(np.arange(len(words)) + window <= ends)
    grams = mix(run_hashes(words, short))
    if not len(starts):
        return starts, starts, grams
    mask = np.uint64((1 << _LOW) - 1)
    ranked = (grams & ~mask) | (np.arange(len(grams), dtype=np.uint64) & mask)
    have = 1
    while have < span:  # least of span places, by doubling
        step = min(have, span - have)
        ranked = np.minimum(ranked[: len(ranked) - step], ranked[step:])
        have += step
    low = (ranked[starts] & mask).astype(np.int64)
    return starts, starts + ((low - starts) & ((1 << _LOW) - 1)), grams


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    """One list for each of n rows; owner is sorted."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), pa.array(values))


def _first_pass(window: int):
    def part(batch: pa.RecordBatch) -> dict:
        raw = texts(batch)
        words, offsets = word_hashes(raw, fold=False)
        _, chosen, grams = _seeds(words, offsets, window)
        places = np.unique(chosen)
        owner = np.searchsorted(offsets, places, side="right") - 1
        return {
            "doc_id": column(batch, "doc_id"),
            "mark": column(batch, "mark"),
            "n_words": np.diff(offsets),
            "whole_sha256": [hashlib.sha256(b" ".join(x.split())).hexdigest() for x in raw],
            "hashes": _lists(_signed(grams[places]), owner, len(raw)),
            "places": _lists((places - offsets[owner]).astype(np.int32), owner, len(raw)),
        }

    return part


def _second_level(window: int):
    """Rows (hash, mark, place): each surviving place extended right (twice the place) and left (twice the place, and one)."""
    short, double = lengths(window)

    def part(batch: pa.RecordBatch) -> dict:
        words, offsets = word_hashes(texts(batch), fold=False)
        twice = mix(run_hashes(words, double) + np.uint64(1)) if len(words) >= double else words[:0]
        found = column(batch, "places")
        counts = np.diff(found.offsets.to_numpy())
        owner = np.repeat(np.arange(len(counts)), counts)
        at = found.flatten().to_numpy().astype(np.int64)
        begin, end = offsets[owner], offsets[owner + 1]
        right, left = begin + at, begin + at - (double - short)
        ok_right, ok_left = right + double <= end, left >= begin
        return {
            "hash": np.concatenate([_signed(twice[right[ok_right]]), _signed(mix(twice[left[ok_left]]))]),
            "mark": column(batch, "mark").take(pa.array(np.concatenate([owner[ok_right], owner[ok_left]]))),
            "place": np.concatenate([at[ok_right] * 2, at[ok_left] * 2 + 1]).astype(np.int32),
        }

    return part


def _windows(raw: bytes, places: list[int], window: int) -> list[bytes]:
    """128 bits of each of a text's windows, of its words joined by a space."""
    split = raw.split()
    joined = b" ".join(split)
    at = np.cumsum([0, *(len(x) + 1 for x in split)]).tolist()
    return [hashlib.blake2b(joined[at[k] : at[k + window] - 1], digest_size=16).digest() for k in places]


def _third_level(window: int):
    """Rows (hash, mark, place): the target windows whose chosen place survives on the side that they hold."""
    short, double = lengths(window)

    def part(batch: pa.RecordBatch) -> dict:
        raw = texts(batch)
        words, offsets = word_hashes(raw, fold=False)
        starts, chosen, _ = _seeds(words, offsets, window)
        found = column(batch, "places")
        counts = np.diff(found.offsets.to_numpy())
        begin = np.repeat(offsets[:-1], counts) * 2
        alive = np.zeros(2 * len(words) + 2, bool)
        alive[begin + found.flatten().to_numpy()] = True
        leftwards = chosen + double > starts + window
        keep = alive[2 * chosen + leftwards]
        starts = starts[keep]
        owner = np.searchsorted(offsets, starts, side="right") - 1
        places = starts - offsets[owner]
        hashes: list[bytes] = []
        for i in np.unique(owner):
            hashes += _windows(raw[i], places[slice(*np.searchsorted(owner, [i, i + 1]))].tolist(), window)
        return {"hash": hashes, "mark": column(batch, "mark").take(pa.array(owner)), "place": places.astype(np.int32)}

    return part


def _repeated(rows: DataFrame, what: str) -> DataFrame:
    """mark, places: of rows (hash, mark, place), all different, those whose hash occurs more than once.

    The repeated hashes are a table of their own, so that both sides of the join are plain exchanges: a hash that very
    many places hold can then be split between tasks when the plan adapts.
    """
    twice = stored(rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("hash"), what)
    return rows.join(twice, "hash").groupBy("mark").agg(F.sort_array(F.collect_list("place")).alias("places"))


def _removal(window: int):
    def part(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"spans": [], "n_removed": [], "kept_sha256": []}
        for raw, places in zip(texts(batch), column(batch, "places").to_pylist()):
            words, spans = raw.split(), []
            for at in places:
                if spans and at <= spans[-1][1]:
                    spans[-1][1] = at + window
                else:
                    spans.append([at, at + window])
            edges = [0, *(x for span in spans for x in span), len(words)]
            kept = [w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b]]
            out["spans"].append([{"first": a, "behind": b} for a, b in spans])
            out["n_removed"].append(len(words) - len(kept))
            out["kept_sha256"].append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return {"mark": column(batch, "mark"), **out}

    return part


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans (of removed words, from 0), one row for each row.

    A word goes if a window that covers it also starts anywhere else in the input. Words are parted by ASCII white space
    and compared as they are. kept_sha256 is of the kept words, joined by one space. Null counts as empty; texts of fewer
    words than a window keep all. Equal texts repeat as a whole, also in rows with the same id. Ids may be of any type and
    null. An empty table gives no rows.
    """
    kind = df.schema[id_col].dataType.simpleString()
    marked = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("mark", digest(F.col("text")))
    first = stored(arrow_map(marked, _first_pass(window), f"doc_id {kind}, mark binary, n_words long, whole_sha256 string, hashes array<long>, places array<int>"), "substrings-first")
    contents = stored(first.groupBy("mark").agg(F.count(F.lit(1)).alias("copies"), F.first(F.struct("hashes", "places")).alias("s")).select("mark", "copies", "s.hashes", "s.places"), "substrings-contents")
    base = stored(first.select("doc_id", "mark", "n_words", "whole_sha256"), "substrings-base")
    forget(first)
    pairs = contents.select("mark", F.explode(F.arrays_zip("hashes", "places")).alias("x")).select(F.col("x.hashes").alias("hash"), "mark", F.col("x.places").alias("place"))
    alive = stored(_repeated(pairs, "substrings-twice-1"), "substrings-level-1")
    copied = stored(contents.where(F.col("copies") > 1).select("mark", F.lit(True).alias("copied")), "substrings-copied")
    forget(contents)
    one_text = marked.groupBy("mark").agg(F.first("text").alias("text"))
    few = stored(one_text.join(alive, "mark"), "substrings-texts")
    second = stored(_repeated(arrow_map(few, _second_level(window), "hash long, mark binary, place int"), "substrings-twice-2"), "substrings-level-2")
    windows = arrow_map(few.select("mark", "text").join(second, "mark"), _third_level(window), "hash binary, mark binary, place int")
    third = stored(_repeated(windows, "substrings-twice-3"), "substrings-level-3")
    cut = arrow_map(few.select("mark", "text").join(third, "mark"), _removal(window), "mark binary, spans array<struct<first:int,behind:int>>, n_removed long, kept_sha256 string")
    out = base.join(copied, "mark", "left").join(cut, "mark", "left")
    whole = F.col("copied") & (F.col("n_words") >= window)
    everything = F.array(F.struct(F.lit(0).alias("first"), F.col("n_words").cast("int").alias("behind")))
    nothing = F.array().cast("array<struct<first:int,behind:int>>")
    return out.select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256"),
        F.when(whole, everything).otherwise(F.coalesce("spans", nothing)).alias("spans"),
    )

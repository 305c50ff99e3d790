"""Sums over resampled places: the draws of hash_draw, made by numpy for many counters at once, and products of matrices.

A draw is a hash of (seed, replicate, number) modulo n, so groups of equal size see the same draws, and groups of any size
the same hashes. How often a replicate draws each place is a row of a matrix; its product with the values of the places is
the replicate's sums. No draw is a row of a table, and nothing goes through the driver.
"""

from __future__ import annotations

import io
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.sources.scratch import stored

#: Places of a group whose values travel together.
PIECE = 1 << 16
#: Values that one task has in memory; more of them are more tasks, each of which makes the draws anew.
VALUES = 1 << 24
#: Parts into which the replicates are dealt; each part gets a copy of the values.
PARTS = 32
#: Counts of drawn places that a task has in memory, and hashes.
COUNTS, HASHES = 1 << 22, 1 << 15

_K = [int(abs(np.sin(i + 1)) * 2**32) for i in range(64)]
_TURN = [s for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in row * 4]
_WORD = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _md5(words: list, n: int) -> np.ndarray:
    """The first 60 bits of md5 of n messages of one block; a word is a number if all messages have the same."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    x, y = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=x), np.bitwise_and(x, b, out=x), np.bitwise_xor(x, d, out=x)
        elif i < 32:
            np.bitwise_xor(b, c, out=x), np.bitwise_and(x, d, out=x), np.bitwise_xor(x, c, out=x)
        elif i < 48:
            np.bitwise_xor(b, c, out=x), np.bitwise_xor(x, d, out=x)
        else:
            np.invert(d, out=x), np.bitwise_or(x, b, out=x), np.bitwise_xor(x, c, out=x)
        np.add(x, a, out=x)
        word = words[_WORD[i]]
        if isinstance(word, int):
            np.add(x, np.uint32((_K[i] + word) & 0xFFFFFFFF), out=x)
        else:
            np.add(x, np.uint32(_K[i]), out=x), np.add(x, word, out=x)
        np.left_shift(x, np.uint32(_TURN[i]), out=y), np.right_shift(x, np.uint32(32 - _TURN[i]), out=x), np.bitwise_or(x, y, out=x)
        np.add(x, b, out=a)
        a, b, c, d = d, a, b, c
    a += np.uint32(_START[0])
    b += np.uint32(_START[1])
    high = a.byteswap().astype(np.uint64)
    return ((high << np.uint64(32)) | b.byteswap()) >> np.uint64(4)


@lru_cache(maxsize=64)
def _digits(first: int, last: int, before: int) -> np.ndarray:
    """Words (word, message) of the numbers from first to last, all of one length, behind a number of bytes, and the mark of the end."""
    size = len(str(first))
    numbers = np.arange(first, last + 1)
    text = np.zeros((len(numbers), (before + size) // 4 * 4 + 4), np.uint8)
    for k in range(size):
        text[:, before + size - 1 - k] = numbers % 10 + 48
        numbers //= 10
    text[:, before + size] = 0x80
    return np.ascontiguousarray(text.view("<u4").T)


def hashes(seed: int, replicates: range, first: int, last: int) -> np.ndarray:
    """hash_draw's 60 bits for (replicate, number), numbers from first to last; replicates of one length."""
    heads = [f"{seed}|{b}|".encode() for b in replicates]
    before, out = len(heads[0]), np.empty((len(heads), last - first + 1), np.uint64)
    assert {len(x) for x in heads} == {before} and before + len(str(last)) <= 55
    at = first
    while at <= last:
        size = len(str(at))
        upto = min(last, 10**size - 1, at // HASHES * HASHES + HASHES - 1)
        tail, width = _digits(at, upto, before), upto - at + 1
        whole = before // 4
        lead = [np.frombuffer(x.ljust(len(tail) * 4, b"\0"), "<u4") for x in heads]
        for k in range(0, len(heads), step := max(1, HASHES // width)):
            some = np.array(lead[k : k + step])
            words: list = [0] * 16
            for j in range(len(tail)):
                if j < whole and len(some) == 1:
                    words[j] = int(some[0, j])
                else:
                    words[j] = (some[:, j, None] | tail[j]).ravel()
            words[14] = (before + size) * 8
            out[k : k + len(some), at - first : upto - first + 1] = _md5(words, len(some) * width).reshape(len(some), width)
        at = upto + 1
    return out


def _narrow(column: pa.Array) -> pa.Array:
    """Whole numbers in the smallest type that holds them."""
    if not pa.types.is_integer(column.type) or column.null_count == len(column):
        return column
    low, high = (x.as_py() for x in pa.compute.min_max(column).values())
    for kind in (pa.uint8(), pa.int8(), pa.uint16(), pa.int16(), pa.int32()):
        least, most = (0, 2**kind.bit_width - 1) if str(kind)[0] == "u" else (-(2 ** (kind.bit_width - 1)), 2 ** (kind.bit_width - 1) - 1)
        if least <= low and high <= most:
            return column.cast(kind)
    return column


def _packed(by: list[str], sums: list[str], schema: pa.Schema):
    def fn(t: pa.Table) -> pa.Table:
        t = t.sort_by("place")
        place = pa.compute.bit_wise_and(t["place"].combine_chunks(), PIECE - 1).cast(pa.uint16())
        batch = pa.record_batch([place, *[_narrow(t[s].combine_chunks()) for s in sums]], names=["place", *sums])
        data = io.BytesIO()
        with pa.ipc.new_stream(data, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(batch)
        one = {c: t[c].slice(0, 1) for c in (*by, "n", "piece")} | {"n_values": pa.array([len(t) * len(sums)]), "data": pa.array([data.getvalue()], pa.binary())}
        return pa.table([one[f.name] for f in schema], schema=schema)

    return fn


def _product(counts: np.ndarray, v: np.ndarray, most: int) -> np.ndarray:
    """Counts (replicate, place) times values (place, column); whole numbers exactly. most: draws of a replicate."""
    if v.dtype.kind == "f":
        clean = np.where(np.isfinite(v), v, 0)
        out = counts @ clean
        for k in np.nonzero(~np.isfinite(v).all(axis=0))[0]:
            bad = ~np.isfinite(v[:, k])
            out[:, k] += np.where(counts[:, bad] > 0, v[bad, k], 0).sum(axis=1)
        return out
    if int(np.abs(v.astype(np.float64)).max(initial=0)) * most < 2**53:
        return np.rint(counts @ v.astype(np.float64)).astype(np.int64)
    return counts.astype(np.int64) @ v.astype(np.int64)


def _drawn(by: list[str], sums: list[str], schema: pa.Schema, b: int, width: int, seed: int):
    def fn(key: tuple, t: pa.Table) -> pa.Table:
        part = key[0].as_py()
        ids = t.select(by).combine_chunks()
        sizes, pieces = t["n"].to_numpy(), t["piece"].to_numpy()
        read = [pa.ipc.open_stream(x.as_py()).read_next_batch() for x in t["data"]]
        names = list(zip(*[ids[c].to_pylist() for c in by], strict=True)) if by else [()] * len(t)
        first_of: dict = {}
        for k, g in enumerate(names):
            first_of.setdefault(g, k)
        group = {g: k for k, g in enumerate(first_of)}
        ns = sorted(set(sizes.tolist()))
        held = {n: sorted({int(p) for p, m in zip(pieces, sizes) if m == n}) for n in ns}
        local = {n: np.full((n - 1) // PIECE + 1, -1, np.int64) for n in ns}
        for n in ns:
            local[n][held[n]] = np.arange(len(held[n]))
        span = {n: n if len(held[n]) == len(local[n]) else len(held[n]) * PIECE for n in ns}
        step = max(1, COUNTS // sum(span.values()))
        found = []
        first = part * width
        while first < min(b, (part + 1) * width):
            upto = min(b, (part + 1) * width, first + step, 10 ** len(str(first)))
            some = range(first, upto)
            counts = {n: np.zeros((len(some), span[n])) for n in ns}
            for at in range(0, ns[-1], most := max(PIECE, COUNTS // len(some))):
                h = hashes(seed, some, at, min(ns[-1], at + most) - 1)
                for n in ns:
                    if at >= n:
                        continue
                    for r in range(len(some)):
                        x = h[r, : n - at]
                        place = (x - x // np.uint64(n) * np.uint64(n)).astype(np.int64)
                        if len(held[n]) < len(local[n]):
                            block = local[n][place >> 16]
                            place = (block << 16 | place & (PIECE - 1))[block >= 0]
                        counts[n][r] += np.bincount(place, minlength=span[n])
            found.append((some, _totals(counts, names, group, sizes, pieces, local, read, sums)))
            first = upto
        out = {c: [] for c in schema.names}
        rows = np.array([*first_of.values()])
        for some, (values, seen, drawn) in found:
            take = pa.array(np.repeat(rows, len(some)))
            for c in by:
                out[c].append(ids[c].combine_chunks().take(take))
            out["replicate"].append(pa.array(np.tile(np.arange(some[0], some[-1] + 1), len(group)), pa.int32()))
            for s in sums:
                out[s].append(pa.array(values[s].ravel(), mask=(seen[s] == 0).ravel()).cast(schema.field(s).type))
            out["drawn"].append(pa.array(drawn.ravel(), pa.int64()))
        t = pa.table([pa.chunked_array(out[f.name], f.type) for f in schema], schema=schema)
        return t.filter(pa.compute.greater(t["drawn"], 0))

    return fn


def _totals(counts: dict, names: list, group: dict, sizes: np.ndarray, pieces: np.ndarray, local: dict, read: list, sums: list[str]) -> tuple:
    """Of each group (group, replicate): the sums, the draws with a value of each, the draws."""
    r = len(next(iter(counts.values())))
    kinds = {s: float if any(pa.types.is_floating(x[s].type) for x in read) else np.int64 for s in sums}
    values = {s: np.zeros((len(group), r), kinds[s]) for s in sums}
    seen, drawn = {s: np.zeros((len(group), r), np.int64) for s in sums}, np.zeros((len(group), r), np.int64)
    alike: dict = {}
    for k in range(len(read)):
        alike.setdefault((int(sizes[k]), int(pieces[k])), []).append(k)
    for (n, piece), members in alike.items():
        start = int(local[n][piece]) * PIECE
        mine = counts[n][:, start : start + min(PIECE, n - piece * PIECE)]
        all_ = np.rint(mine.sum(axis=1)).astype(np.int64)
        dense = []
        for k in members:
            x, g = read[k], group[names[k]]
            place = x["place"].to_numpy()
            whole = len(place) == mine.shape[1]
            if not whole and len(place) * 8 < mine.shape[1]:
                few = mine[:, place]
                drawn[g] += (here := np.rint(few.sum(axis=1)).astype(np.int64))
                for s in sums:
                    v, there = _filled(x[s])
                    values[s][g] += _product(few, v[:, None], n)[:, 0]
                    seen[s][g] += here if there is None else _product(few, there[:, None], n)[:, 0]
                continue
            if whole:
                drawn[g] += all_
            else:
                present = np.zeros(mine.shape[1], np.uint8)
                present[place] = 1
                dense.append((drawn[g], present))
            for s in sums:
                v, there = _filled(x[s])
                for row, col in ((values[s][g], v), (seen[s][g], there)):
                    if col is None and whole:
                        row += all_
                        continue
                    col = np.ones(len(place), np.uint8) if col is None else col
                    if not whole:
                        full = np.zeros(mine.shape[1], col.dtype)
                        full[place] = col
                        col = full
                    dense.append((row, col))
        for kind in sorted({col.dtype.str for _, col in dense}):
            same = [(row, col) for row, col in dense if col.dtype.str == kind]
            for at in range(0, len(same), 64):
                some = same[at : at + 64]
                for p in range(0, mine.shape[1], 8192):
                    got = _product(mine[:, p : p + 8192], np.stack([col[p : p + 8192] for _, col in some], axis=1), n)
                    for j, (row, _) in enumerate(some):
                        row += got[:, j]
    return values, seen, drawn


def _filled(x: pa.Array) -> tuple[np.ndarray, np.ndarray | None]:
    """Values with 0 for null, and where there is one (None: everywhere)."""
    if not x.null_count:
        return x.to_numpy(zero_copy_only=False), None
    return x.fill_null(0).to_numpy(zero_copy_only=False), x.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)


def drawn_sums(placed: DataFrame, by: list[str], sums: list[str], b: int, seed: int) -> DataFrame:
    """by..., replicate and the sums over each replicate's n draws from the places 0 to n - 1; placed: by..., place, n, sums...

    Draws of places that a group lacks add nothing; a replicate without any place of a group has no row for it.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    p = placed.select(*by, F.col("n").cast("long").alias("n"), F.shiftright("place", 16).cast("long").alias("piece"), F.col("place").cast("long").alias("place"), *sums)
    keys = T.StructType([p.schema[c] for c in (*by, "n", "piece")])
    pack = T.StructType([*keys, T.StructField("n_values", T.LongType()), T.StructField("data", T.BinaryType())])
    packs = stored(p.groupBy(*by, "n", "piece").applyInArrow(_packed(by, sums, to_arrow_schema(pack)), pack), "packs")
    tiles = max(1, -(-(packs.agg(F.sum("n_values")).first()[0] or 0) // VALUES))
    width = -(-b // PARTS)
    copies = packs.withColumn("__tile", F.pmod(F.xxhash64(*by, "piece"), F.lit(tiles))).withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit((b - 1) // width))))
    out = T.StructType([*[p.schema[c] for c in by], T.StructField("replicate", T.IntegerType()), *[p.schema[s] for s in sums], T.StructField("drawn", T.LongType())])
    dealt = copies.repartition(2 * PARTS * min(tiles, 16), "__part", "__tile").groupBy("__part", "__tile")
    each = dealt.applyInArrow(_drawn(by, sums, to_arrow_schema(out), b, width, seed), out)
    return each.groupBy(*by, "replicate").agg(*[F.sum(s).alias(s) for s in sums])

"""Near duplicates: SuperMinHash signatures, banding, verification on full shingle sets, union-find by star contraction.

SuperMinHash gives each element a permutation of the signature's places and takes, at each place, the least of rank plus
a fraction over the elements. Ranks of one element differ at all places, which makes the estimate's variance lower than
that of independent minima. Here all elements of all texts go through the ranks together: rank 0 of every element, then
rank 1 and so on, and a text leaves as soon as no later rank can lower any of its places (early stopping).

Texts with equal shingle sets are one class, by 128 bits of hash. Classes that share a band meet in rounds: each is held
against the band's leader, not against all others; then, in bands that still hold more than one component, against further
leaders. What these bands still leave apart meets by a parity signature: a bit for each of 1,024 parts of the shingles' hash
space says whether the set's number of shingles there is odd. Two sets differ in at least as many shingles as their
signatures differ in bits, so the join drops a pair whose bits already rule out the similarity asked for, and what it
lets through is verified. So a large group costs a few comparisons a member, and no pair of a band that could be similar
stays unexamined unless both are known to be connected. Verification compares the words themselves before a link counts.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import arrow_map, column, digest, forget, stored, texts
from quillmill.llm.hashing import mix, run_hashes, word_hashes

#: Places of a signature (a power of 2), and bands. 32 bands of 4 miss a pair of similarity 0.8 once in twenty million.
PLACES, BANDS = 128, 32
#: Long values of a parity signature, 64 bits each, and open members of a band that meet in one tile of the last join at
#: most. Both decide the cost, not the result.
PARITY, TILE = 16, 1024
_FRACTION = 40


def shingle_sets(raw: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles, sorted, for all texts in turn, and where each text's begin.

    A text of fewer words than a shingle has one, all its words; one without words has none.
    """
    words, offsets = word_hashes(raw, fold=True)
    counts = np.diff(offsets)
    grams = run_hashes(words, size) if len(words) >= size else words[:0]
    owner = np.repeat(np.arange(len(raw)), np.maximum(counts - size + 1, 0))
    first = np.cumsum(np.maximum(counts - size + 1, 0)) - np.maximum(counts - size + 1, 0)
    places = np.arange(len(owner)) - np.repeat(first, np.maximum(counts - size + 1, 0)) + np.repeat(offsets[:-1], np.maximum(counts - size + 1, 0))
    values = [mix(grams[places] + np.uint64(size))]
    owners = [owner]
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        n = int(counts[i])
        values.append(mix(run_hashes(words[offsets[i] : offsets[i + 1]], n) + np.uint64(n)))
        owners.append(np.array([i]))
    value, owner = np.concatenate(values), np.concatenate(owners)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(len(raw) + 1))


def signatures(values: np.ndarray, offsets: np.ndarray, places: int = PLACES) -> np.ndarray:
    """SuperMinHash of each set: rank << 40 | fraction at each place. An empty set has the largest values everywhere."""
    n = len(offsets) - 1
    out = np.full(n * places, np.iinfo(np.uint64).max, np.uint64)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    seed = mix(values ^ np.uint64(0xA0761D6478BD642F))
    mask = np.uint64(places - 1)
    start, stride = seed & mask, (seed >> np.uint64(16)) & mask | np.uint64(1)  # place of rank j: start + j * stride, a permutation
    for rank in range(places):
        at = owner * places + ((start + np.uint64(rank) * stride) & mask).astype(np.int64)
        value = np.uint64(rank << _FRACTION) | (mix(seed + np.uint64((rank + 1) * 0xE7037ED1A0B428DB % (1 << 64))) >> np.uint64(64 - _FRACTION))
        np.minimum.at(out, at, value)
        live = np.unique(owner)
        open_ = live[out.reshape(n, places)[live].max(1) >= np.uint64((rank + 1) << _FRACTION)]
        if not len(open_):
            break
        if len(open_) < len(live):
            keep = np.zeros(n, bool)
            keep[open_] = True
            stays = keep[owner]
            owner, seed, start, stride = owner[stays], seed[stays], start[stays], stride[stays]
    return out.reshape(n, places)


def band_hashes(signature: np.ndarray, bands: int) -> np.ndarray:
    grouped = signature.reshape(len(signature), bands, -1)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), grouped.shape[:2]).copy()
    for k in range(grouped.shape[2]):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + grouped[:, :, k])
    return out


def _describe(size: int, places: int, bands: int):
    def part(batch: pa.RecordBatch) -> dict:
        raw = texts(batch)
        values, offsets = shingle_sets(raw, size)
        counts = np.diff(offsets)
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(mix(values ^ np.uint64(0x8EBC6AF09C88C6E3)), out=total[1:])
        node = mix((total[offsets[1:]] - total[offsets[:-1]]) + counts.astype(np.uint64))
        np.cumsum(mix(values ^ np.uint64(0x2545F4914F6CDD1D)), out=total[1:])
        check = mix(total[offsets[1:]] - total[offsets[:-1]])
        found = band_hashes(signatures(values, offsets, places), bands).view(np.int64)
        sizes = np.where(counts > 0, bands, 0)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(found[counts > 0].ravel()))
        return {"doc_id": column(batch, "doc_id"), "mark": column(batch, "mark"), "n_shingles": counts, "node": node.view(np.int64), "check": check.view(np.int64), "bands": lists}

    return part


def parities(values: np.ndarray, offsets: np.ndarray, parity: int = PARITY) -> np.ndarray:
    """For each set ``parity`` values of 64 bits; a bit is set if an odd number of the set's shingles fall on it."""
    out = np.zeros((len(offsets) - 1) * parity, np.uint64)
    at = mix(values ^ np.uint64(0xD1342543DE82EF95))
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    np.bitwise_xor.at(out, owner * parity + ((at >> np.uint64(6)) % np.uint64(parity)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out.reshape(-1, parity)


def _parities(size: int):
    def part(batch: pa.RecordBatch) -> dict:
        found = parities(*shingle_sets(texts(batch), size)).view(np.int64)
        return {"node": column(batch, "node"), **{f"p{k}": found[:, k] for k in range(PARITY)}}

    return part


def _plain(raw: bytes, size: int) -> set[tuple[bytes, ...]]:
    """The set of a text's shingles as words."""
    words = raw.lower().split()
    return set(zip(*(words[i:] for i in range(size)))) if len(words) >= size else {tuple(words)} if words else set()


def _verify(size: int, share: tuple[int, int]):
    """Rows (a, b) of those (a, b, text, other) whose sets are similar enough. Others mostly come in runs: their sets are remembered.

    What the hashes call similar is confirmed on the words.
    """
    least, of = share
    memory: OrderedDict[int, tuple[np.ndarray, set]] = OrderedDict()

    def part(batch: pa.RecordBatch) -> dict:
        a, b = column(batch, "a").to_pylist(), column(batch, "b").to_pylist()
        raw = texts(batch)
        values, offsets = shingle_sets(raw, size)
        others = column(batch, "other").cast(pa.binary())

        def enough(both: int, one: int, other: int) -> bool:
            return of * both >= least * (one + other - both)

        keep = []
        for i, other in enumerate(b):
            if other not in memory:
                text = others[i].as_py() or b""
                memory[other] = shingle_sets([text], size)[0], _plain(text, size)
                if len(memory) > 64:
                    memory.popitem(last=False)
            one, plain = memory[other]
            mine = values[offsets[i] : offsets[i + 1]]
            if of * min(len(mine), len(one)) < least * max(len(mine), len(one)):
                keep.append(False)
                continue
            if not enough(len(np.intersect1d(mine, one, assume_unique=True)), len(mine), len(one)):
                keep.append(False)
                continue
            words = _plain(raw[i], size)
            keep.append(enough(len(words & plain), len(words), len(plain)))
        mask = np.array(keep, bool)
        return {"a": np.array(a, np.int64)[mask], "b": np.array(b, np.int64)[mask]}

    return part


def components(edges: DataFrame, what: str = "components") -> DataFrame:
    """node, component (its least node) of all nodes of edges(a, b): large and small stars in turn until nothing changes.

    Edges live in tables of the shared folder between the rounds; the driver sees a count and a checksum. The stars settle
    after a number of rounds that grows with the logarithm of the longest chain; not to settle in 64 is an error.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{what}-0")
    before = None
    for k in range(1, 64):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e")).where("e.a <> e.m").select("e.a", F.col("e.m").alias("b")).distinct()
        last, now = now, stored(small, f"{what}-{k}")
        forget(last)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if seen == before:
            break
        before = seen
    else:
        raise RuntimeError(f"{what} did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _salted(salt: int) -> Column:
    """Who leads: by salt 0 the same order in all bands, so that a group has few leaders; by others each band has its own."""
    return F.xxhash64(F.lit(salt), F.col("node"), *([F.col("band")] if salt else []))


def link(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 2, share: tuple[int, int] = (80, 100), places: int = PLACES, bands: int = BANDS, leaders: int = 4, tile: int = TILE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, one row for each row.

    Texts are linked if share[1] * intersection >= share[0] * union of their sets of shingles of ``size`` words, A-Z
    folded; component_id is the least doc_id that links reach, in the ids' own type and order. A text without words is its
    own component, null counts as such. A null doc_id counts as larger than any other. Rows with equal ids are told apart
    by their texts; repeated rows stay. An empty table gives no rows.
    """
    made: list[DataFrame] = []

    def keep(rows: DataFrame, what: str) -> DataFrame:
        made.append(stored(rows, what))
        return made[-1]

    kind = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("mark", digest(F.col("text")))
    described = keep(arrow_map(docs, _describe(size, places, bands), f"doc_id {kind}, mark binary, n_shingles long, node long, check long, bands array<long>"), "neardup-described")
    twins = keep(described.where("n_shingles > 0").groupBy("node").agg(F.min("check").alias("low"), F.max("check").alias("high")).where("low <> high").select("node", "low"), "neardup-twins")
    if not twins.isEmpty():  # different sets whose first 64 bits agree: all but one get another node
        described = described.join(twins, "node", "left").withColumn("node", F.when(F.col("check") != F.col("low"), F.xxhash64(F.lit("twin"), "check")).otherwise(F.col("node"))).drop("low")
    some = described.where("n_shingles > 0")
    classes = keep(some.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("mark").alias("mark"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "neardup-classes")
    rows = keep(described.select("doc_id", "n_shingles", "node"), "neardup-rows")
    banded = classes.select("node", F.explode("bands").alias("band"))
    crowds = banded.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    together = keep(banded.join(crowds, "band"), "neardup-together")
    met = keep(together.join(classes.select("node", "mark", "n"), "node"), "neardup-bands")
    # the texts that take part in any comparison, one for each class
    wanted = met.select("mark").distinct()
    held = docs.select("mark", "text").groupBy("mark").agg(F.first("text").alias("text"))
    held = keep(held.join(wanted, "mark").join(classes.select("mark", "node"), "mark").select("node", "text"), "neardup-texts")

    def linked(pairs: DataFrame, what: str) -> DataFrame:
        """Of pairs(a, b) those that are similar enough; b is the one that many share."""
        first = pairs.join(held.select(F.col("node").alias("a"), "text"), "a")
        second = first.join(held.select(F.col("node").alias("b"), F.col("text").alias("other")), "b")
        return keep(arrow_map(second, _verify(size, share), "a long, b long"), what)

    def sizes_fit(n: Column, other: Column) -> Column:
        return share[1] * F.least(n, other) >= share[0] * F.greatest(n, other)

    def led(members: DataFrame, salts: list[int], what: str) -> DataFrame:
        """Pairs of each member with its bands' leaders, the least by each salt, of another component."""
        pairs = None
        for salt in salts:
            top = members.groupBy("band").agg(F.min_by(F.struct("node", "n", "component"), _salted(salt)).alias("top"))
            one = members.join(top, "band").where((F.col("component") != F.col("top.component")) & sizes_fit(F.col("n"), F.col("top.n"))).select(F.col("node").alias("a"), F.col("top.node").alias("b"))
            pairs = one if pairs is None else pairs.union(one)
        return keep(pairs.distinct(), what)

    def grouped(members: DataFrame, edges: DataFrame, what: str) -> DataFrame:
        """The members with the components that the edges make, as far as bands hold more than one."""
        parts = members.drop("component").join(components(edges, what), "node", "left").withColumn("component", F.coalesce("component", "node"))
        parts = keep(parts, f"{what}-members")
        split = parts.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("band")
        return keep(parts.join(split, "band"), f"{what}-open")

    members = met.withColumn("component", F.col("node"))
    tested = led(members, [0], "neardup-pairs-0")
    edges = linked(tested, "neardup-edges-0")
    members = grouped(members.where("members > 2"), edges, "neardup-round-0")
    if not members.isEmpty():
        more = led(members, list(range(1, leaders)), "neardup-pairs-1")
        fresh = more.join(tested, ["a", "b"], "left_anti").join(tested.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
        edges, tested = edges.union(linked(fresh, "neardup-edges-1")), tested.union(more)
        members = grouped(members, edges, "neardup-round-1")
    if not members.isEmpty():
        # In each open band everyone outside the largest component meets all of other components, each pair in the first
        # band that it shares. Tiles of a bounded number of members by a bounded number of outsiders part the work of a
        # large band; the signatures' condition is part of the join, so that few rows leave it.
        parity = arrow_map(held.join(members.select("node").distinct(), "node", "left_semi"), _parities(size), "node long, " + ", ".join(f"p{k} long" for k in range(PARITY)))
        parity = keep(parity.join(classes.select("node", "bands"), "node"), "neardup-parities")
        parts = members.groupBy("band", "component").agg(F.count(F.lit(1)).alias("in_part"))
        main = parts.groupBy("band").agg(F.max_by("component", F.struct("in_part", "component")).alias("main"), F.sum("in_part").alias("all"), F.max("in_part").alias("most"))
        tiles = main.select("band", "main", F.ceil(F.col("all") / tile).alias("tiles"), F.ceil((F.col("all") - F.col("most")) / tile).alias("strips"))
        open_ = keep(members.select("band", "node", "component", "n").join(tiles, "band"), "neardup-tiled")
        place = lambda what, of: F.pmod(F.xxhash64(F.lit(what), "node"), F.col(of))
        every = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))
        ours = open_.withColumn("tile", place("tile", "tiles")).withColumn("strip", every("strips")).join(parity, "node")
        theirs = open_.where("component <> main").withColumn("strip", place("strip", "strips")).withColumn("tile", every("tiles")).join(parity, "node")
        theirs = theirs.select("band", "tile", "strip", F.col("node").alias("b"), F.col("component").alias("its"), F.col("n").alias("m"), F.col("bands").alias("others"), *[F.col(f"p{k}").alias(f"q{k}") for k in range(PARITY)])
        differ = sum((F.bit_count(F.col(f"p{k}").bitwiseXOR(F.col(f"q{k}"))) for k in range(1, PARITY)), F.bit_count(F.col("p0").bitwiseXOR(F.col("q0"))))
        may = (share[1] + share[0]) * differ <= (share[1] - share[0]) * (F.col("n") + F.col("m"))
        shared = F.zip_with("bands", "others", lambda x, y: x == y)
        first_shared = F.get(F.col("bands"), (F.array_position(shared, True) - 1).cast("int")) == F.col("band")
        each_once = (F.col("component") == F.col("main")) | (F.col("node") < F.col("b"))
        met_here = ours.join(theirs, ["band", "tile", "strip"]).where((F.col("component") != F.col("its")) & each_once & sizes_fit(F.col("n"), F.col("m")) & may & first_shared)
        pairs = met_here.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
        done = tested.union(tested.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        edges = edges.union(linked(keep(pairs.join(done, ["a", "b"], "left_anti"), "neardup-pairs-2"), "neardup-edges-2"))
    found = components(edges, "neardup-final")
    for table in made:  # what the result reads stays
        if table is not classes and table is not rows:
            forget(table)
    labelled = classes.select("node", "least").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    named = labelled.join(lowest, "component").select("node", "component_id")
    out = rows.join(named, "node", "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """The rows, in all columns, of which none is a near duplicate of another: of each component the least id stays.

    Rows that repeat with id and text stay once; texts without words all stay. Rows that share an id but not the text stay
    if one of them does.
    """
    found = link(df, id_col, text_col, size, share)
    stays = found.where("kept").groupBy(F.col("doc_id").alias("__id")).agg(F.max("n_shingles").alias("__n")).select("__id", "__n")
    worded = F.col(text_col).isNotNull() & F.col(text_col).rlike(r"[^\x20\x09-\x0D]")
    rest = df.where(worded).join(stays.where("__n > 0"), F.col(id_col).eqNullSafe(F.col("__id")), "left_semi").dropDuplicates([id_col, text_col])
    return rest.unionByName(df.where(~worded))

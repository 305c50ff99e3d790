"""Document likelihood over a subword lattice.

The vocabulary is an existing one; its pieces' scores (ranks of merges, as files of this kind hold them) make the prior
of a unigram model, p proportional to 1 / (rank + shift). Expected counts of pieces over the training words, from
forward and backward sums over all segmentations of each distinct word, update it. The lattice of a word holds the
pieces, a spelling of each character by its bytes, so that no text has probability 0, and for a word of the training
texts one edge over all of it, with the word's own share; the share of words seen once, what new words can expect, is
left to the pieces. A word's probability is the sum over all paths, by forward recursion in log space. Pieces don't
cross words, so a document's probability is the product over its words and the end.

Words are counted over the whole corpus. The most frequent ones, a bounded number, are shipped to the executors; the
others go to their words' counts by a shuffle, summed before for each document.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import arrow_map, column, row_mark, stored, texts

#: What a vocabulary of this kind puts before a word's first character.
MARK = "▁"
#: Characters up to which words of one length are handled together.
TOGETHER = 48
LOG10 = math.log(10)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass(frozen=True)
class Pieces:
    """Pieces (text), the bytes' pieces and the end: log-probabilities in order, those of bytes 0 to 255, that of the end."""

    pieces: tuple[str, ...]
    logs: tuple[float, ...]
    bytes_: tuple[float, ...]
    end: float


def read_vocabulary(path: str, shift: float = 2.7) -> Pieces:
    """The prior that a model file's scores make. Byte pieces and the end share the rank behind the last piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found, raw = {}, {}
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            raw[int(model.id_to_piece(i)[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            found[model.id_to_piece(i)] = -model.get_score(i)
    last = max(found.values(), default=0.0) + 1
    weight = {p: 1 / (rank + shift) for p, rank in found.items()}
    tail = 1 / (last + shift)
    total = sum(weight.values()) + 257 * tail
    return Pieces(tuple(weight), tuple(math.log(w / total) for w in weight.values()), (math.log(tail / total),) * 256, math.log(tail / total))


class Lattice:
    """Forward and backward sums over the segmentations of words, many words of one length at a time."""

    def __init__(self, model: Pieces):
        self.model = model
        self.longest = max(map(len, model.pieces), default=1)
        self.index = {p: i for i, p in enumerate(model.pieces)}
        self.logs = np.array([*model.logs, -np.inf])
        self.raw = np.array(model.bytes_)
        # a table from hashes of pieces to their places; a second one holds what falls together in the first
        bits = max(8, (8 * len(model.pieces)).bit_length())
        self.shift = np.uint64(64 - bits)
        hashes = np.array([self._hash(p) for p in model.pieces], np.uint64)
        self.keys, self.places = [], []
        rest = np.arange(len(hashes))
        self.turns = []
        turn = 0x9E3779B97F4A7C15
        while len(rest):
            slot = (hashes[rest] * np.uint64(turn)) >> self.shift
            _, first = np.unique(slot, return_index=True)
            keys, places = np.zeros(1 << bits, np.uint64), np.full(1 << bits, len(hashes), np.int32)
            keys[slot[first]], places[slot[first]] = hashes[rest[first]], rest[first]
            self.keys.append(keys)
            self.places.append(places)
            self.turns.append(np.uint64(turn))
            turn = (turn * 0xD1342543DE82EF95 + 2) % (1 << 64) | 1
            rest = np.delete(rest, first)

    @staticmethod
    def _hash(piece: str) -> int:
        out = 0
        for c in piece:
            out = (out * 0x100000001B3 + ord(c) + 1) % (1 << 64)
        return out

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), len(self.model.pieces), np.int32)
        for keys, places, turn in zip(self.keys, self.places, self.turns):
            slot = (hashes * turn) >> self.shift
            out = np.where(keys[slot] == hashes, places[slot], out)
        return out

    def spelled(self, char: str) -> float:
        return float(self.raw[list(char.encode())].sum())

    def _edges(self, codes: np.ndarray) -> list[list[tuple[int, np.ndarray]]]:
        """codes: words x characters. For each end, the (start, piece) of all pieces that end there."""
        n, size = codes.shape
        out: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(size + 1)]
        for start in range(size):
            h = np.zeros(n, np.uint64)
            for end in range(start + 1, min(size, start + self.longest) + 1):
                h = h * np.uint64(0x100000001B3) + codes[:, end - 1] + np.uint64(1)
                found = self._find(h)
                if (found < len(self.model.pieces)).any():
                    out[end].append((start, found))
        return out

    def _spelling(self, codes: np.ndarray) -> np.ndarray:
        distinct, back = np.unique(codes, return_inverse=True)
        return np.array([self.spelled(chr(int(c))) for c in distinct])[back.reshape(codes.shape)]

    def _forward(self, codes: np.ndarray, edges, spell: np.ndarray) -> np.ndarray:
        ahead = np.full((codes.shape[1] + 1, len(codes)), -np.inf)
        ahead[0] = 0.0
        for end in range(1, codes.shape[1] + 1):
            total = ahead[end - 1] + spell[:, end - 1]
            for start, found in edges[end]:
                total = np.logaddexp(total, ahead[start] + self.logs[found])
            ahead[end] = total
        return ahead

    def _groups(self, words: list[str]):
        """(places, codes) of the words by length; a word that is too long to share an array comes alone."""
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by.setdefault(len(w), []).append(i)
        for size, places in by.items():
            for lot in [places] if size <= TOGETHER else [[i] for i in places]:
                yield lot, np.frombuffer("".join(words[i] for i in lot).encode("utf-32-le"), np.uint32).reshape(len(lot), size).astype(np.uint64)

    def log_probabilities(self, words: list[bytes]) -> np.ndarray:
        """Natural log of each word's probability over all its segmentations."""
        marked = [MARK + w.decode() for w in words]
        out = np.empty(len(words))
        for places, codes in self._groups(marked):
            out[places] = self._forward(codes, self._edges(codes), self._spelling(codes))[-1] if len(places) > 1 else self.one(marked[places[0]])
        return out

    def one(self, word: str) -> float:
        """The same for a single word, character by character."""
        ahead = [0.0]
        for end in range(1, len(word) + 1):
            terms = [ahead[end - 1] + self.spelled(word[end - 1])]
            for start in range(max(0, end - self.longest), end):
                if (i := self.index.get(word[start:end])) is not None:
                    terms.append(ahead[start] + self.model.logs[i])
            top = max(terms)
            ahead.append(top + math.log(sum(math.exp(t - top) for t in terms)))
        return ahead[-1]

    def expected(self, words: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected uses of each piece and of each byte in the words, counted as often as given."""
        marked = [MARK + w.decode() for w in words]
        uses, spent = np.zeros(len(self.model.pieces) + 1), np.zeros(256)
        for places, codes in self._groups(marked):
            edges, spell, n = self._edges(codes), self._spelling(codes), counts[places]
            size = codes.shape[1]
            ahead = self._forward(codes, edges, spell)
            back = np.full((size + 1, len(codes)), -np.inf)
            back[size] = 0.0
            for end in range(size, 0, -1):
                back[end - 1] = np.logaddexp(back[end - 1], back[end] + spell[:, end - 1])
                for start, found in edges[end]:
                    back[start] = np.logaddexp(back[start], back[end] + self.logs[found])
            for end in range(1, size + 1):
                share = np.exp(ahead[end - 1] + spell[:, end - 1] + back[end] - ahead[size]) * n
                chars, place = np.unique(codes[:, end - 1], return_inverse=True)
                for c, x in zip(chars, np.bincount(place, share)):
                    for b in chr(int(c)).encode():
                        spent[b] += x
                for start, found in edges[end]:
                    uses += np.bincount(found, np.exp(ahead[start] + self.logs[found] + back[end] - ahead[size]) * n, len(uses))
        return uses[:-1], spent


@lru_cache(maxsize=2)
def _lattice(model: Pieces) -> Lattice:
    return Lattice(model)


@dataclass(frozen=True)
class Corpus:
    """Counted words: a table (word, n_train, n, log10_p), the training tokens N, their distinct V, the end's count and log10 probability."""

    words: DataFrame
    train_tokens: int
    train_distinct: int
    ends: int
    end_log10: float


def _count(batch: pa.RecordBatch) -> dict:
    held, seen = column(batch, "held_out").to_pylist(), (Counter(), Counter())
    for out, raw in zip(held, texts(batch)):
        seen[out].update(raw.lower().split())
    keys = list(seen[0].keys() | seen[1].keys())
    return {"word": keys, "n_train": [seen[0][k] for k in keys], "n": [seen[0][k] + seen[1][k] for k in keys]}


def fit(docs: DataFrame, vocabulary: str | None = None, rounds: int = 1, prior_weight: float = 0.01) -> Corpus:
    """Count the words of docs(text, held_out) and learn the pieces' probabilities from those not held out.

    Words are parted by ASCII white space, A-Z folded; each text, null ones too, has one end. All counts are over the
    whole corpus. prior_weight is the vocabulary's own distribution against the expected counts. Without training words
    the prior stays.
    """
    spark = docs.sparkSession
    counted = stored(arrow_map(docs.select("held_out", "text"), _count, "word binary, n_train long, n long").groupBy("word").agg(F.sum("n_train").alias("n_train"), F.sum("n").alias("n")), "lattice-words")
    totals = counted.agg(F.sum("n_train"), F.count(F.when(F.col("n_train") > 0, 1)), F.count(F.when(F.col("n_train") == 1, 1))).first()
    ends = docs.where(~F.col("held_out")).count()
    model = prior = read_vocabulary(vocabulary or default_vocabulary())
    for _ in range(rounds):
        shipped = spark.sparkContext.broadcast(model)

        def spread(batch: pa.RecordBatch) -> dict:
            uses, spent = _lattice(shipped.value).expected(column(batch, "word").to_pylist(), np.ones(batch.num_rows))
            both = np.concatenate([uses, spent])
            used = np.flatnonzero(both)
            return {"place": used, "uses": both[used]}

        trained = counted.where("n_train > 0").select("word")
        # one row for each piece at most: the vocabulary bounds what comes to the driver
        got = arrow_map(trained, spread, "place int, uses double", text="word", limit=1 << 18).groupBy("place").agg(F.sum("uses").alias("uses")).collect()
        if not got:
            break
        uses = np.zeros(len(prior.pieces) + 257)
        for r in got:
            uses[r.place] = r.uses
        weight = prior_weight * uses.sum()
        mixed = np.log((uses + weight * np.exp([*prior.logs, *prior.bytes_, prior.end])) / (uses.sum() + weight))
        model = Pieces(prior.pieces, tuple(mixed[: len(prior.pieces)].tolist()), tuple(mixed[-257:-1].tolist()), float(mixed[-1]))
    last = spark.sparkContext.broadcast(model)
    tokens = int(totals[0] or 0) + ends
    new = ((totals[2] or 0) + 0.5) / (tokens + 1)  # the share that new words can expect

    def score(batch: pa.RecordBatch) -> dict:
        pieces = _lattice(last.value).log_probabilities(column(batch, "word").to_pylist()) + math.log(new)
        with np.errstate(divide="ignore"):
            whole = np.log(column(batch, "n_train").to_numpy() * ((1 - new) / max(tokens, 1)))
        return {"word": column(batch, "word"), "n_train": column(batch, "n_train"), "n": column(batch, "n"), "log10_p": np.logaddexp(whole, pieces) / LOG10}

    words = stored(arrow_map(counted, score, "word binary, n_train long, n long, log10_p double", text="word", limit=1 << 18), "lattice-scored")
    end_p = np.logaddexp(math.log(ends * (1 - new) / tokens) if ends else -np.inf, math.log(new) + model.end) / LOG10
    return Corpus(words, tokens, int(totals[1] or 0) + (ends > 0), ends, float(end_p))


def score(docs: DataFrame, corpus: Corpus, id_col: str = "doc_id", shipped_words: int = 100_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of docs(doc_id, text, held_out), one row for each row.

    base_score: sum of log10((c + 1) / (N + 1 * (V + 1))) over the words and the end, c the token's count in training
    texts. score: log10 of the model's probability of the text. The most frequent words, ``shipped_words`` at most, are
    looked up on the spot; the table of all others is joined. Null and empty texts have the end alone. Repeated rows stay.
    Ids may be of any type and null.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    n, v = corpus.train_tokens, corpus.train_distinct
    floor = math.log10(n + (v + 1))
    # by eighths of a power of 2 of their counts: a few hundred numbers say from which count on the words are few enough
    power = F.floor(8 * F.log2("n"))
    least, room = None, shipped_words
    for r in sorted(corpus.words.groupBy(power.alias("power")).agg(F.count(F.lit(1)).alias("words")).collect(), key=lambda r: -r.power):
        if r.words > room:
            break
        least, room = r.power, room - r.words
    head = {} if least is None else {bytes(r.word): (r.n_train, r.log10_p) for r in corpus.words.where(power >= least).collect()}
    shipped = spark.sparkContext.broadcast(head)
    end_base, end_log, ends = math.log10(corpus.ends + 1) - floor, corpus.end_log10, corpus.ends
    keyed = docs.select(F.col(id_col).alias("doc_id"), "held_out", "text").withColumn("mark", row_mark("doc_id", "text"))

    def near(batch: pa.RecordBatch) -> dict:
        known = shipped.value
        out: dict[str, list] = {"n_tokens": [], "n_known": [], "base_score": [], "score": [], "rest": []}
        for raw in texts(batch):
            seen = Counter(raw.lower().split())
            total, sure, base, log, rest = 1, int(ends > 0), [end_base], [end_log], []
            for word, times in seen.items():
                total += times
                if (found := known.get(word)) is None:
                    rest.append((word, times))
                else:
                    sure += times * (found[0] > 0)
                    base.append(times * (math.log10(found[0] + 1) - floor))
                    log.append(times * found[1])
            for key, value in (("n_tokens", total), ("n_known", sure), ("base_score", math.fsum(base)), ("score", math.fsum(log)), ("rest", [{"word": w, "times": t} for w, t in rest])):
                out[key].append(value)
        return {"doc_id": column(batch, "doc_id"), "held_out": column(batch, "held_out"), "mark": column(batch, "mark"), **out}

    shape = f"doc_id {kind}, held_out boolean, mark string, n_tokens long, n_known long, base_score double, score double, rest array<struct<word:binary,times:int>>"
    first = stored(arrow_map(keyed, near, shape), "lattice-near")
    # rows that repeat ask once
    asked = first.where(F.size("rest") > 0).groupBy("mark").agg(F.first("rest").alias("rest")).select("mark", F.explode("rest").alias("x")).select("mark", "x.word", "x.times")
    far = asked.join(corpus.words.select("word", "n_train", "log10_p"), "word").groupBy("mark").agg(
        F.sum(F.when(F.col("n_train") > 0, F.col("times").cast("long")).otherwise(0)).alias("far_known"),
        F.sum(F.col("times") * (F.log10(F.col("n_train") + 1) - F.lit(floor))).alias("far_base"),
        F.sum(F.col("times") * F.col("log10_p")).alias("far_score"),
    )
    some = lambda c, zero: F.coalesce(F.col(c), F.lit(zero))
    return first.drop("rest").join(far, "mark", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + some("far_known", 0)).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_score") + some("far_base", 0.0)).alias("base_score"),
        (F.col("score") + some("far_score", 0.0)).alias("score"),
    )


def with_hold_out(df: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return df.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"), held_out.alias("held_out"))

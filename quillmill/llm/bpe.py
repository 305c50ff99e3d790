"""Byte-level BPE as a monoid: halves are encoded by themselves and joined by re-encoding a window around the cut.

The pattern that splits text before the merges never lets a match run from a character that is not white space into
white space. So every place with white space behind a character that is none starts a match, whatever stands around it.
A join looks for such a place on either side of the cut, in windows that double until one is found or a half is used
up, encodes what lies between the two places anew, and keeps all other ids of both halves: they cannot change.
The join is associative, so any tree over the text gives the ids of the whole.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import arrow_map, column

#: Characters that a leaf of the tree may hold: ordinary documents have several.
LEAF = 256
#: Ids that a leaf of the decoding tree may hold.
DECODE_LEAF = 8192


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Codec:
    """Encoder and decoder for one rank file; ``leaf`` sets the tree's leaves, in characters."""

    def __init__(self, ranks: bytes, pattern: str, leaf: int = LEAF):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.leaf = max(1, leaf)
        self.plain = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.token = [b""] * (max(table.values()) + 1)
        for token, rank in table.items():
            self.token[rank] = token
        self.size = [len(x) for x in self.token]
        self.digits = [str(i) for i in range(len(self.token))]

    def encode(self, text: str) -> list[int]:
        return self.plain(text) if len(text) <= self.leaf else self._tree(text, 0, len(text))

    def _tree(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf:
            return self.plain(text[lo:hi])
        cut = (lo + hi) // 2
        return self._join(text, self._tree(text, lo, cut), self._tree(text, cut, hi), lo, cut, hi)

    def _join(self, text: str, left: list[int], right: list[int], lo: int, cut: int, hi: int) -> list[int]:
        begin, end = _settled_before(text, lo, cut), _settled_after(text, cut, hi)
        keep, drop = len(left), len(text[begin:cut].encode())
        while drop > 0:
            keep -= 1
            drop -= self.size[left[keep]]
        skip, drop = 0, len(text[cut:end].encode())
        while drop > 0:
            drop -= self.size[right[skip]]
            skip += 1
        return left[:keep] + self.plain(text[begin:end]) + right[skip:]

    def decode(self, ids) -> bytes:
        return self._concat(ids, 0, len(ids))

    def _concat(self, ids, lo: int, hi: int) -> bytes:
        if hi - lo <= DECODE_LEAF:
            token = self.token
            return b"".join([token[i] for i in ids[lo:hi]])
        mid = (lo + hi) // 2
        return self._concat(ids, lo, mid) + self._concat(ids, mid, hi)

    def joined(self, ids) -> bytes:
        digits = self.digits
        return ",".join([digits[i] for i in ids]).encode()


def _settled(text: str, at: int) -> bool:
    return text[at] in " \n\t\r" and not text[at - 1].isspace()


def _settled_before(text: str, lo: int, cut: int) -> int:
    """The last place in (lo, cut) where a match starts for certain; lo if there is none."""
    window, seen = 16, cut
    while seen > lo + 1:
        start = max(lo + 1, cut - window)
        for at in range(seen - 1, start - 1, -1):
            if _settled(text, at):
                return at
        window, seen = window * 2, start
    return lo


def _settled_after(text: str, cut: int, hi: int) -> int:
    """The first place in (cut, hi) where a match starts for certain; hi if there is none."""
    window, seen = 16, cut + 1
    while seen < hi:
        stop = min(hi, cut + 1 + window)
        for at in range(seen, stop):
            if _settled(text, at):
                return at
        window, seen = window * 2, stop
    return hi


@lru_cache(maxsize=2)
def codec(ranks: bytes, pattern: str, leaf: int = LEAF) -> Codec:
    """One for each worker process."""
    return Codec(ranks, pattern, leaf)


def _shipped(df: DataFrame, vocabulary: str | None, pattern: str | None):
    """The ranks, the pattern and the leaves' size. A text is one leaf for any pattern but the default one, of which alone the joins' argument is known to hold."""
    with open(vocabulary or default_vocabulary(), "rb") as f:
        ranks = f.read()
    return df.sparkSession.sparkContext.broadcast(ranks), pattern or default_pattern(), LEAF if pattern in (None, default_pattern()) else sys.maxsize


def _strings(batch: pa.RecordBatch) -> list[str]:
    return [x or "" for x in column(batch, "text").to_pylist()]


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str | None = None, ids: bool = True) -> DataFrame:
    """doc_id, n_tokens long and, with ``ids``, ids array<int> of every whole text, as the rank file's library encodes it.

    Null and empty texts have no ids. A row goes in and out on its own: repeated rows stay, ids may be null.
    The vocabulary is a file of ranks on the driver, shipped once to each executor; it is of fixed size.
    """
    ranks, split, leaf = _shipped(df, vocabulary, pattern)

    def part(batch: pa.RecordBatch) -> dict:
        use = codec(ranks.value, split, leaf)
        got = [use.encode(x) for x in _strings(batch)]
        sizes = [len(x) for x in got]
        out = {"doc_id": column(batch, "doc_id"), "n_tokens": sizes}
        if ids:
            flat = np.fromiter((i for x in got for i in x), np.int32, sum(sizes))
            out["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
        return out

    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), part, f"doc_id {kind}, n_tokens long" + ", ids array<int>" * ids)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and text: the ids' bytes, concatenated up the tree. Null ids count as none; an id that the file lacks is an error."""
    ranks, split, leaf = _shipped(df, vocabulary, pattern)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        use = codec(ranks.value, split, leaf)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([use.decode(x or []).decode() for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"doc_id {kind}, text string")


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: each whole text encoded and its ids decoded, without leaving the worker."""
    ranks, split, leaf = _shipped(df, vocabulary, pattern)

    def part(batch: pa.RecordBatch) -> dict:
        use = codec(ranks.value, split, leaf)
        sizes, shown, back = [], [], []
        for text in _strings(batch):
            got = use.encode(text)
            sizes.append(len(got))
            shown.append(hashlib.sha256(use.joined(got)).hexdigest())
            back.append(hashlib.sha256(use.decode(got)).hexdigest())
        return {"doc_id": column(batch, "doc_id"), "n_tokens": sizes, "ids_sha256": shown, "decoded_sha256": back}

    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), part, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")

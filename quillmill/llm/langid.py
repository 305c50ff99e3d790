"""Language identification by compression: the language whose text helps zstandard most.

Each language has a raw-content dictionary, cut from labelled texts. A text is compressed with every dictionary; the
smallest result names the language. The margin to the second smallest tells how sure that is, and rejects text that no
language helps.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.llm.common import arrow_map, column

UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Dictionaries:
    """Language names, the one with most labelled rows first, and the raw content of each one's dictionary."""

    names: tuple[str, ...]
    content: tuple[bytes, ...]
    level: int = 6


#: Bytes that are compressed at a time: a longer run would learn the text itself, and the dictionaries would differ less.
BLOCK = 1024


def fit(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 300, sample_chars: int = 400, dict_bytes: int = 1 << 15, max_langs: int = 400, level: int = 6) -> Dictionaries:
    """Dictionaries from a bounded sample of the labelled rows: the ``per_lang`` rows of each language whose ids hash lowest.

    Of each sampled text a piece of ``sample_chars`` characters serves, at a place that the id's hash chooses in the whole
    text, equal pieces once. If a language's pieces hold more than ``dict_bytes``, the longest are cut until all fit.
    The bounds are parameters; what they bound is the driver's and the dictionaries' size, and not what is classified.
    Rows with a null language or text are no sample. No labelled row at all gives no language. More than ``max_langs``
    languages are an error.
    """
    labelled = df.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = labelled.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_lang).select("doc_id", "lang").limit(per_lang * max_langs + 1)
    ids = sorted({(r.doc_id, r.lang) for r in chosen.collect() if r.doc_id is not None})
    if len({lang for _, lang in ids}) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    if not ids:
        return Dictionaries((), (), level)
    few = df.sparkSession.createDataFrame(ids, f"doc_id {df.schema[id_col].dataType.simpleString()}, lang string")
    start = 1 + F.pmod(F.xxhash64(F.col(id_col), F.lit("piece")), F.greatest(F.length(text_col) - sample_chars + 1, F.lit(1))).cast("int")
    texts = df.where(train & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("rank"), F.col(text_col).substr(start, F.lit(sample_chars)).alias("text")).join(F.broadcast(few), ["doc_id", "lang"], "left_semi")
    found: dict[str, dict[bytes, None]] = {}
    for r in sorted(texts.collect(), key=lambda r: (r.rank, r.doc_id, r.text)):
        found.setdefault(r.lang, {})[r.text.lower().encode()] = None
    rows = {r.lang: r["count"] for r in labelled.groupBy("lang").count().where(F.col("lang").isin(sorted(found))).collect()}
    names = sorted(found, key=lambda x: (-rows[x], x))
    return Dictionaries(tuple(names), tuple(_joined(list(found[x]), dict_bytes) for x in names), level)


def _joined(pieces: list[bytes], room: int) -> bytes:
    """All pieces in their order, a line each; the longest are cut to the one length at which all fit."""
    left, most = room, room
    for i, n in enumerate(sorted(map(len, pieces))):
        if n + 1 > left // (len(pieces) - i):
            most = max(0, left // (len(pieces) - i) - 1)
            break
        left -= n + 1
    return b"\n".join(p[:most] for p in pieces)[:room]


@lru_cache(maxsize=4)
def _compressors(model: Dictionaries) -> list:
    import zstandard

    out = []
    for content in model.content:
        raw = zstandard.ZstdCompressionDict(content or b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(level=model.level)
        out.append(zstandard.ZstdCompressor(level=model.level, dict_data=raw, write_content_size=False))
    return out


def sizes(model: Dictionaries, text: str) -> list[int]:
    """Bytes of the whole text, in lower case and block by block, under each dictionary."""
    raw = text.lower().encode()
    blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
    return [sum(map(len, map(c.compress, blocks))) for c in _compressors(model)]


def decide(model: Dictionaries, text: str | None) -> tuple[str, float]:
    """Language and margin, 1 - smallest / second smallest; a tie goes to the language with more labelled rows and has margin 0."""
    if not text or not model.names or not _LETTER.search(text):
        return UNKNOWN, 0.0
    got = sizes(model, text)
    best = min(range(len(got)), key=got.__getitem__)
    rest = min((x for i, x in enumerate(got) if i != best), default=0)
    return model.names[best], max(0.0, 1 - got[best] / rest) if rest else 1.0


def rejects(text: str | None, name: str, margin: float, min_margin: float, min_chars: int = 256) -> bool:
    """No language, or a narrow margin in a text long enough for its language to show."""
    return name == UNKNOWN or margin < min_margin and len(text or "") >= min_chars


def classify(df: DataFrame, model: Dictionaries, min_margin: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (the margin, 0 to 1) and rejected for every whole text.

    Null texts and texts without a letter are ``und``, with score 0, and rejected; so are all with no language learned.
    A margin below ``min_margin`` rejects texts of 256 characters or more, but keeps the smallest one's name. Repeated rows stay, equal texts get equal values.
    """
    shipped = df.sparkSession.sparkContext.broadcast(model)

    def part(batch: pa.RecordBatch) -> dict:
        found = [decide(shipped.value, x) for x in column(batch, "text").to_pylist()]
        return {"doc_id": column(batch, "doc_id"), "lang_pred": [x for x, _ in found], "score": [m for _, m in found], "rejected": [rejects(t, x, m, min_margin) for t, (x, m) in zip(column(batch, "text").to_pylist(), found)]}

    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), part, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def keep_known(df: DataFrame, model: Dictionaries, min_margin: float, text_col: str = "text") -> DataFrame:
    """The rows, all their columns as they are, whose text isn't rejected by ``classify``."""
    shipped = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            read = column(batch, text_col).to_pylist()
            found = [decide(shipped.value, x) for x in read]
            yield batch.filter(pa.array([not rejects(t, x, m, min_margin) for t, (x, m) in zip(read, found)], pa.bool_()))

    return df.mapInArrow(run, df.schema)

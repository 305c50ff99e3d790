"""Toxic passages as maximum-scoring segments.

A token's score is its log-odds between toxic and clean labelled texts under an informative Dirichlet prior, the
pooled counts. Only tokens whose log-odds stand out against their own variance score; every other token costs what it
would cost in a passage of the given density. One linear scan then finds all maximal segments of a text. The best
segments of clean texts follow an extreme-value law with two parameters; it turns segment scores into log-odds net of
the text's length, and these sum to the document's probability.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import arrow_map, column, stored, texts

#: ASCII other than letters and digits parts words.
_PART = {c: " " for c in range(128) if not chr(c).isalnum()}
#: The most evidence that counts.
MOST = 60.0
#: Word scores that a worker remembers before it starts anew.
_REMEMBER = 1 << 20


@dataclass(frozen=True)
class Model:
    """Scores of the features that count, the cost of any other word, the extreme-value law, the logistic curve."""

    scores: dict[str, float]
    other: float
    lam: float = 1.0
    k: float = 1.0
    base: float = 0.0
    slope: float = 0.0


def words(text: bytes) -> list[str]:
    """Lower-case words of letters, digits and all that isn't ASCII."""
    return text.decode().translate(_PART).lower().split()


def features(word: str, sizes: tuple[int, ...] = (4, 5)) -> set[str]:
    """The word, closed by a space, and its character n-grams: what is new as a word may have a known stem."""
    return {word + " "} | {word[i : i + n] for n in sizes for i in range(len(word) - n + 1)}


class WordScores(dict):
    """word: the largest log-odds of its features, 0 without any that counts. Remembers what it has looked up."""

    def __init__(self, scores: dict[str, float]):
        self.features = scores

    def __missing__(self, word: str) -> float:
        if len(self) >= _REMEMBER:
            self.clear()
        found = max((s for f in features(word) if (s := self.features.get(f, 0.0))), default=0.0)
        if len(word) < 64:
            self[word] = found
        return found


_known: dict[int, WordScores] = {}


def _lookup(scores: dict[str, float]) -> WordScores:
    """One for each worker process and model."""
    if (found := _known.get(id(scores))) is None or found.features is not scores:
        _known.clear()
        found = _known[id(scores)] = WordScores(scores)
    return found


def segments(tokens: list[str], scores: WordScores, other: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments, (first token, behind the last, score), in one pass.

    Tokens without a score only lower the running sum, so the scan steps from one scored token to the next. Candidates
    keep a link to the nearest earlier one that began lower, which makes the search for a merge linear as a whole.
    """
    found: list[list] = []  # first, behind, sum before, sum behind, link
    total, before = 0.0, 0
    for at, s in [(i, s) for i, w in enumerate(tokens) if (s := scores[w])]:
        total += other * (at - before)
        before = at + 1
        low, high, first = total, total + s, at
        total = high
        while True:
            link = len(found) - 1
            while link >= 0 and found[link][2] >= low:
                link = found[link][4]
            if link < 0 or found[link][3] >= high:
                found.append([first, at + 1, low, high, link])
                break
            first, low = found[link][0], found[link][2]
            del found[link:]
    return [(a, b, high - low) for a, b, low, high, _ in found]


def evidence(n: int, found: list[tuple[int, int, float]], model: Model) -> float:
    """Of a text of n words: the sum over its segments of -log(expected by chance), as far as above 0. At most MOST."""
    if not found:
        return 0.0
    chance = math.log(model.k * n)
    return min(MOST, sum(max(0.0, model.lam * s - chance) for *_, s in found))


def assess(n: int, found: list[tuple[int, int, float]], model: Model) -> float:
    """The probability that a text of n words with these segments is toxic."""
    return 1 / (1 + math.exp(-(model.base + model.slope * evidence(n, found, model))))


def _logistic(rows: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Base and slope, not below 0, that fit (x, toxic, clean); Newton steps on the penalised likelihood."""
    base = slope = 0.0
    for _ in range(50):
        g0, g1, h00, h01, h11 = 0.0, -1e-3 * slope, 1e-6, 0.0, 1e-3
        for x, toxic, clean in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, base + slope * x))))
            n, d = toxic + clean, toxic - (toxic + clean) * p
            w = n * p * (1 - p)
            g0, g1, h00, h01, h11 = g0 + d, g1 + d * x, h00 + w, h01 + w * x, h11 + w * x * x
        det = h00 * h11 - h01 * h01
        if det <= 0:
            break
        move = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        base, slope = base + max(-2.0, min(2.0, move[0])), max(0.0, slope + max(-2.0, min(2.0, move[1])))
        if max(map(abs, move)) < 1e-9:
            break
    return base, slope


def _sketch(raw: bytes) -> int:
    """The least hash of the text's runs of three words: near copies mostly share it."""
    found = words(raw)
    return min((xxhash.xxh64_intdigest(" ".join(found[i : i + 3])) for i in range(max(1, len(found) - 2))), default=0) - (1 << 63)


def fit(docs: DataFrame, labels: DataFrame, train: Column, max_labelled: int = 20_000, prior_share: float = 0.1, min_z: float = 4.0, min_odds: float = 1.5, density: float = 0.1, max_features: int = 20_000) -> Model:
    """Learn from labelled rows only: docs(doc_id, text), labels(doc_id, toxic), the condition ``train`` on doc_id.

    Of more than ``max_labelled`` labelled rows a share of about that many is taken by the ids' hash; texts with the same
    sketch, near copies as a rule, count once. ``prior_share`` is the prior's weight against the counts, ``density`` the share of toxic words in a toxic
    passage; a feature needs ``min_odds`` and ``min_z``, and of more than ``max_features`` those with the largest z score. A doc_id with several labels counts as toxic if one
    says so; null labels, ids and texts are left out. With no toxic or no clean text nothing scores.
    """
    spark = docs.sparkSession
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).where(train).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    share = 1 << 20 if n <= max_labelled else max(1, (max_labelled << 20) // n)
    few = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share)
    text = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(few), "doc_id")
    sketched = arrow_map(text.select("toxic", "text"), lambda part: {"toxic": column(part, "toxic"), "text": column(part, "text"), "sketch": [_sketch(x) for x in texts(part)]}, "toxic int, text string, sketch long")
    sample = stored(sketched.groupBy("sketch").agg(F.max(F.struct("toxic", "text")).alias("row")).select("row.toxic", "row.text"), "toxicity-sample")

    def count(batch: pa.RecordBatch) -> dict:
        seen = Counter(), Counter()
        for toxic, raw in zip(column(batch, "toxic").to_pylist(), texts(batch)):
            seen[toxic > 0].update(set().union(*map(features, set(words(raw)))))
        keys = sorted(seen[0].keys() | seen[1].keys())
        return {"feature": keys, "toxic": [seen[1][k] for k in keys], "clean": [seen[0][k] for k in keys]}

    counts = arrow_map(sample, count, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    totals, classes = counts.agg(F.sum("toxic"), F.sum("clean")).first(), sample.agg(F.sum((F.col("toxic") > 0).cast("long")), F.count(F.lit(1))).first()
    other = math.log(1 - density)
    prior = math.log(((classes[0] or 0) + 0.5) / ((classes[1] or 0) - (classes[0] or 0) + 0.5))
    if not totals[0] or not totals[1]:
        return Model({}, other, base=prior)
    toxic, clean = float(totals[0]), float(totals[1])
    pooled = toxic + clean
    weight = prior_share * pooled
    a = (F.col("toxic") + F.col("clean")) * (weight / pooled)
    odds = lambda y, of: F.log((y + a) / (of + weight - y - a))
    scored = counts.select("feature", (odds(F.col("toxic"), toxic) - odds(F.col("clean"), clean)).alias("odds"), (1 / (F.col("toxic") + a) + 1 / (F.col("clean") + a)).alias("variance"))
    z = F.col("odds") / F.sqrt("variance")
    rows = scored.where((F.col("odds") >= min_odds) & (z >= min_z)).orderBy(z.desc(), "feature").limit(max_features).collect()
    if not rows:
        return Model({}, other, base=prior)
    scores = {r.feature: r.odds for r in rows}
    shipped = spark.sparkContext.broadcast(scores)

    def chance(batch: pa.RecordBatch) -> dict:
        use, out = _lookup(shipped.value), {"n": [], "segments": [], "total": []}
        for raw in texts(batch):
            tokens = words(raw)
            found = segments(tokens, use, other)
            out["n"].append(len(tokens))
            out["segments"].append(len(found))
            out["total"].append(sum(s for *_, s in found))
        return out

    law = arrow_map(sample.where(F.col("toxic") <= 0).select("text"), chance, "n long, segments long, total double").agg(F.sum("n"), F.sum("segments"), F.sum("total")).first()
    model = Model(scores, other, (law[1] + 1) / (law[2] + max(scores.values())), (law[1] + 1) / (law[0] + 1))
    curve = spark.sparkContext.broadcast(model)

    def weigh(batch: pa.RecordBatch) -> dict:
        m, seen = curve.value, Counter()
        use = _lookup(m.scores)
        for toxic, raw in zip(column(batch, "toxic").to_pylist(), texts(batch)):
            tokens = words(raw)
            seen[round(evidence(len(tokens), segments(tokens, use, other), m), 2), toxic > 0] += 1
        return {"x": [x for x, _ in seen], "toxic": [n if y else 0 for (_, y), n in seen.items()], "clean": [0 if y else n for (_, y), n in seen.items()]}

    seen = arrow_map(sample, weigh, "x double, toxic long, clean long").groupBy("x").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).collect()
    base, slope = _logistic([(r.x, r.toxic, r.clean) for r in seen])
    return Model(scores, other, model.lam, model.k, base, slope)


def scan(df: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", passages: bool = True) -> DataFrame:
    """doc_id, n_tokens, score, predicted and, with ``passages``, every significant segment of every whole text.

    passages: array of first token, behind the last, score and expected number by chance, those with less than one
    expected. Null and empty texts have no tokens and the probability of a text without segments. Repeated rows stay.
    """
    shipped = df.sparkSession.sparkContext.broadcast(model)

    def part(batch: pa.RecordBatch) -> dict:
        m = shipped.value
        use = _lookup(m.scores)
        out: dict[str, list] = {"n_tokens": [], "score": [], "predicted": []} | ({"passages": []} if passages else {})
        for text in texts(batch):
            tokens = words(text)
            found = segments(tokens, use, m.other)
            score = assess(len(tokens), found, m)
            out["n_tokens"].append(len(tokens))
            out["score"].append(score)
            out["predicted"].append(int(score >= threshold))
            if passages:
                expected = [(a, b, s, m.k * len(tokens) * math.exp(-m.lam * s)) for a, b, s in found]
                out["passages"].append([{"first": a, "behind": b, "score": s, "expected": e} for a, b, s, e in expected if e < 1])
        return {"doc_id": column(batch, "doc_id"), **out}

    kind = df.schema[id_col].dataType.simpleString()
    shape = f"doc_id {kind}, n_tokens long, score double, predicted int" + ", passages array<struct<first:int,behind:int,score:double,expected:double>>" * passages
    return arrow_map(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), part, shape)

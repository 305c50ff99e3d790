"""Overlap metrics between a reference and a candidate, per row, and the sums that corpus scores need."""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def _plain(grams: Sequence, n: int) -> Counter:
    return Counter(tuple(grams[i : i + n]) for i in range(len(grams) - n + 1))


def _shared(cand: Counter, ref: Counter) -> int:
    return sum((cand & ref).values())


def _by_row(fn: Callable[[str, str], float]):
    @pandas_udf(T.DoubleType())
    def run(ref: pd.Series, cand: pd.Series) -> pd.Series:
        return pd.Series([None if r is None or c is None else fn(r, c) for r, c in zip(ref, cand)], dtype="float64")

    return run


def _word_list(text: str) -> list[str]:
    import re

    return re.findall(r"\w+|[^\w\s]", text.lower())


def _char_list(text: str) -> list[str]:
    return list("".join(text.split()))


def _brevity(cand: int, ref: int) -> float:
    return math.exp(min(0.0, 1.0 - ref / max(1, cand)))


def bleu_of(ref: Sequence, cand: Sequence, skip_missing: bool, epsilon: float = 1e-9) -> float:
    """Geometric mean of clipped precisions to 4-grams times brevity; an order without any match counts as epsilon.

    skip_missing: an order that the candidate is too short for adds nothing (its weight stays), instead of epsilon.
    """
    if not ref or not cand:
        return 0.0
    total = 0.0
    for n in range(1, 5):
        have = max(0, len(cand) - n + 1)
        if not have and skip_missing:
            continue
        p = _shared(_plain(cand, n), _plain(ref, n)) / max(1, have)
        total += 0.25 * math.log(p if p > 0 else epsilon)
    return _brevity(len(cand), len(ref)) * math.exp(total)


bleu_chars = _by_row(lambda r, c: bleu_of(_char_list(r), _char_list(c), False))
bleu_words = _by_row(lambda r, c: bleu_of(_word_list(r), _word_list(c), False))
sentence_bleu_proxy = _by_row(lambda r, c: bleu_of(_word_list(r), _word_list(c), True))


def _smoothed(r: str, c: str) -> float:
    """Character BLEU in which an order without a match has 0.1 of one."""
    ref, cand = _char_list(r), _char_list(c)
    if not ref or not cand or not _shared(_plain(cand, 1), _plain(ref, 1)):
        return 0.0
    total = 0.0
    for n in range(1, 5):
        total += 0.25 * math.log((_shared(_plain(cand, n), _plain(ref, n)) or 0.1) / max(1, len(cand) - n + 1))
    return _brevity(len(cand), len(ref)) * math.exp(total)


bleu_smoothed_chars = _by_row(_smoothed)


def _gleu(r: str, c: str) -> float:
    """Pooled 1- to 4-gram matches over the larger total, words by white space."""
    ref, cand = r.split(), c.split()
    if not ref or not cand:
        return 0.0
    hit = sum(_shared(_plain(cand, n), _plain(ref, n)) for n in range(1, 5))
    total = lambda k: sum(max(0, k - n + 1) for n in range(1, 5))
    return hit / max(1, total(len(ref)), total(len(cand)))


sentence_gleu = _by_row(_gleu)


def _vowel(word: str, i: int) -> bool:
    return word[i] in "aeiou" or word[i] == "y" and i > 0 and not _vowel(word, i - 1)


def _measure(stem: str) -> int:
    kinds = [_vowel(stem, i) for i in range(len(stem))]
    return sum(a and not b for a, b in zip(kinds, kinds[1:]))


def _cvc(word: str) -> bool:
    n = len(word)
    return n > 2 and not _vowel(word, n - 1) and _vowel(word, n - 2) and not _vowel(word, n - 3) and word[-1] not in "wxy"


# Fixed suffix rules of the published stemming algorithm (steps 2, 3 and 4).
STEP_2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def stem(word: str) -> str:
    """Porter's stemmer; words of up to three letters stay."""
    if len(word) <= 3:
        return word
    has_vowel = lambda s: any(_vowel(s, i) for i in range(len(s)))
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for end in ("ed", "ing"):
            if word.endswith(end) and has_vowel(word[: -len(end)]):
                word = word[: -len(end)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and not _vowel(word, len(word) - 1) and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _cvc(word):
                    word += "e"
                break
    if word.endswith("y") and has_vowel(word[:-1]):
        word = word[:-1] + "i"
    for rules in (STEP_2, STEP_3):
        hit = max((r for r in rules if word.endswith(r[0])), key=lambda r: len(r[0]), default=None)
        if hit and _measure(word[: -len(hit[0])]) > 0:
            word = word[: -len(hit[0])] + hit[1]
    hit = max((e for e in STEP_4 if word.endswith(e)), key=len, default=None)
    if hit and _measure(word[: -len(hit)]) > 1 and (hit != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(hit)]
    if word.endswith("e") and (_measure(word[:-1]) > 1 or _measure(word[:-1]) == 1 and not _cvc(word[:-1])):
        word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def _f1(hit: int, ref: int, cand: int) -> float:
    return 2 * hit / (ref + cand) if hit else 0.0


def _longest_common(a: list[str], b: list[str]) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@pandas_udf(T.StructType([T.StructField(x, T.DoubleType()) for x in ("rouge1", "rouge2", "rougeL")]))
def rouge(ref: pd.Series, cand: pd.Series) -> pd.DataFrame:
    """F-measures over stemmed [a-z0-9]+ tokens; blank or null texts give 0."""
    import re

    def tokens(text: str | None) -> list[str]:
        return [stem(w) for w in re.findall("[a-z0-9]+", (text or "").lower())]

    out = []
    for r, c in zip(map(tokens, ref), map(tokens, cand)):
        pair = [_f1(_shared(_plain(c, n), _plain(r, n)), max(0, len(r) - n + 1), max(0, len(c) - n + 1)) for n in (1, 2)]
        out.append((*pair, _f1(_longest_common(r, c), len(r), len(c))))
    return pd.DataFrame(out, columns=["rouge1", "rouge2", "rougeL"])


def _unigrams(r: str, c: str) -> float:
    ref, cand = _word_list(r), _word_list(c)
    return _f1(_shared(_plain(cand, 1), _plain(ref, 1)), len(ref), len(cand))


#: Unigram F1 over word tokens, without stemming.
rouge1_f1 = _by_row(_unigrams)


def _lesser(r: str, c: str) -> float:
    ref, cand = _word_list(r), _word_list(c)
    both = [n for n in range(1, 5) if len(ref) >= n and len(cand) >= n]
    return sum(_shared(_plain(cand, n), _plain(ref, n)) / (max(len(ref), len(cand)) - n + 1) for n in both) / max(1, len(both))


#: Mean, over the orders 1 to 4 that both have, of the lesser of precision and recall.
gleu_like = _by_row(_lesser)

SUMS = ("ref_len", "cand_len", *(f"{kind}{n}" for n in range(1, 5) for kind in ("match", "total")))


def bleu_statistics(ref: Column, cand: Column, chars: bool = False) -> Column:
    """A struct of whole numbers whose sums make corpus BLEU: lengths, and matches and totals of each order. Null texts add none."""
    tokens = _char_list if chars else _word_list

    @pandas_udf(T.StructType([T.StructField(x, T.LongType()) for x in SUMS]))
    def run(r: pd.Series, c: pd.Series) -> pd.DataFrame:
        out = []
        for a, b in zip(r, c):
            x, y = ([], []) if a is None or b is None else (tokens(a), tokens(b))
            out.append([len(x), len(y), *(v for n in range(1, 5) for v in (_shared(_plain(y, n), _plain(x, n)), max(0, len(y) - n + 1)))])
        return pd.DataFrame(out, columns=list(SUMS))

    return run(ref, cand)


def corpus_bleu(sums: dict[str, Column]) -> Column:
    """0 to 100 from summed statistics; 0 if an order has no match."""
    logs = sum((F.log(sums[f"match{n}"] / sums[f"total{n}"]) for n in range(2, 5)), F.log(sums["match1"] / sums["total1"]))
    short = F.least(F.lit(0.0), 1 - sums["ref_len"] / sums["cand_len"])
    some = sums["match1"] > 0
    for n in range(2, 5):
        some = some & (sums[f"match{n}"] > 0)
    return F.when(some, 100 * F.exp(short + logs / 4)).otherwise(F.lit(0.0))


def task_metric(task: Column, ref: Column, cand: Column) -> Column:
    """The metric that a task is scored by; 0 for an unknown one."""
    return F.when(task == "wmt19_en_zh", bleu_chars(ref, cand)).when(task == "wmt19_zh_en", bleu_words(ref, cand)).when(task == "coedit_gec", gleu_like(ref, cand)).when(task == "gigaword", rouge1_f1(ref, cand)).otherwise(F.lit(0.0))


#: Orders of character and of word n-grams in chrF++, and the weight of recall.
CHRF_CHARS, CHRF_WORDS, CHRF_BETA = 6, 2, 2
CHRF_SUMS = tuple(f"{what}{k}" for k in range(CHRF_CHARS + CHRF_WORDS) for what in ("cand", "ref", "both"))


def _parted_words(text: str) -> list[str]:
    """Words by white space, a mark at an end, or else at the start, of a longer word apart."""
    out: list[str] = []
    for word in text.split():
        if len(word) > 1 and word[-1] in string.punctuation:
            out += [word[:-1], word[-1]]
        elif len(word) > 1 and word[0] in string.punctuation:
            out += [word[0], word[1:]]
        else:
            out.append(word)
    return out


@pandas_udf(T.StructType([T.StructField(n, T.LongType()) for n in CHRF_SUMS]))
def chrf_statistics(ref: pd.Series, cand: pd.Series) -> pd.DataFrame:
    """For each order the candidate's n-grams (none where the reference has none), the reference's and those in common."""
    rows = []
    for r, c in zip(ref, cand):
        sides = ((_char_list(r or ""), _char_list(c or ""), CHRF_CHARS), (_parted_words(r or ""), _parted_words(c or ""), CHRF_WORDS))
        row: list[int] = []
        for a, b, orders in sides:
            for n in range(1, orders + 1):
                x, y = _plain(a, n), _plain(b, n)
                row += [sum(y.values()) if x else 0, sum(x.values()), _shared(y, x)]
        rows.append(row)
    return pd.DataFrame(rows, columns=list(CHRF_SUMS))


def corpus_chrf(sums: dict[str, Column]) -> Column:
    """chrF++ of summed statistics, 0 to 100: precision and recall averaged over the orders that both sides have."""
    orders = range(CHRF_CHARS + CHRF_WORDS)
    live = [(sums[f"cand{k}"] > 0) & (sums[f"ref{k}"] > 0) for k in orders]
    mean = lambda side: sum((F.when(x, sums[f"both{k}"] / sums[f"{side}{k}"]).otherwise(0.0) for k, x in zip(orders, live)), F.lit(0.0))
    n = sum((x.cast("int") for x in live), F.lit(0))
    p, r = F.try_divide(mean("cand"), n), F.try_divide(mean("ref"), n)
    return F.coalesce(F.try_divide(100 * (1 + CHRF_BETA**2) * p * r, CHRF_BETA**2 * p + r), F.lit(0.0))

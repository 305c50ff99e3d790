"""Text keys, tokens and parsers as Column expressions; Arrow UDFs only where Spark lacks the function."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf, udtf

#: Parts the fields of a composite key.
SEP = "\x1f"
#: Fixed set: the white space of Unicode and the four separators of ASCII.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_CJK = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]"


def strip(text: Column) -> Column:
    """The text without white space of any kind at its ends."""
    return F.btrim(text, F.lit(WHITE))


@pandas_udf(T.StringType())
def norm(s: pd.Series) -> pd.Series:
    """NFKC, case-folded, without any white space; null stays null."""
    return s.map(lambda x: None if x is None else "".join(unicodedata.normalize("NFKC", x).casefold().split()))


def text_key(text: Column) -> Column:
    """sha256 of the normalised text: equal for texts that differ in case, width or white space."""
    return F.sha2(norm(text), 256)


def simple_key(text: Column) -> Column:
    """Folded words joined by one space."""
    return F.array_join(F.filter(F.split(F.regexp_replace(F.lower(text), "ß", "ss"), r"(?U)\s+"), lambda w: w != ""), " ")


def composite_key(*parts: Column) -> Column:
    """sha256 of the parts joined by a separator that no text holds; nulls count as empty."""
    return F.sha2(F.concat_ws(SEP, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


@pandas_udf(T.StringType())
def canonical_digest(s: pd.Series) -> pd.Series:
    """sha256 of a JSON text in canonical form: sorted keys, no spaces. Null, broken or non-finite JSON gives null."""
    import hashlib

    def one(x: str | None) -> str | None:
        try:
            return None if x is None else hashlib.sha256(json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()).hexdigest()
        except ValueError:
            return None

    return s.map(one)


def hash_rank(*parts: Column) -> Column:
    """A 60-bit rank that depends on the parts alone: 15 hexadecimal digits of their key."""
    return F.conv(F.substring(composite_key(*parts), 1, 15), 16, 10).cast("long")


def hash_draw(n: Column, *parts: Column) -> Column:
    """A draw from 0 to n - 1 by a counter hash: 60 bits of md5 over the parts joined by '|', modulo n."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("long") % n


def seed31(*parts: Column) -> Column:
    """A seed below 2**31 from the parts."""
    return F.pmod(hash_rank(*parts), F.lit(1 << 31))


def crc_seed(text: Column, salt: int) -> Column:
    return F.pmod(F.crc32(text).bitwiseXOR(F.lit(salt).cast("long")), F.lit(1 << 31))


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def char_tokens(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(text, r"(?U)\s", ""), ""), lambda c: c != "")


def word_tokens(text: Column) -> Column:
    """Runs of word characters and single other marks, lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+|[^\w\s])"), 1)


def field_tokens(text: Column) -> Column:
    """Tokens for retrieval: [a-z0-9]+ runs; with any CJK character all characters and their neighbouring pairs."""

    def with_pairs(chars: Column) -> Column:
        pairs = F.when(F.size(chars) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(chars) - 1, F.lit(1))), lambda i: F.concat(F.get(chars, i - 1), F.get(chars, i)))).otherwise(F.array().cast("array<string>"))
        return F.concat(chars, pairs)

    return F.when(text.rlike(_CJK), let(char_tokens(text), with_pairs)).otherwise(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1))


def language_aware_tokens(text: Column) -> Column:
    return F.when(text.rlike(r"[\x{4e00}-\x{9fff}]"), char_tokens(text)).otherwise(word_tokens(text))


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of n tokens, joined by the separator; none of fewer tokens."""
    runs = lambda t: F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(t, i, n), SEP))).otherwise(F.array().cast("array<string>"))
    return let(tokens, runs)


def ngram_jaccard(a: Column, b: Column, n: int) -> Column:
    """Of the distinct n-grams: 1 if neither has any, 0 if one has none."""

    def share(p: Column) -> Column:
        x, y = p["x"], p["y"]
        return F.when((F.size(x) == 0) & (F.size(y) == 0), F.lit(1.0)).when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))

    return let(F.struct(F.array_distinct(ngrams(a, n)).alias("x"), F.array_distinct(ngrams(b, n)).alias("y")), share)


# Fixed markers behind which an answer stands, in order.
MARKERS = ("### SPLIT ###", "Refined Translation:", "Refined Summary:", "Corrected:", "Summary:", "Chinese:", "English:")


def answer(text: Column) -> Column:
    """The text without thinking, behind the last of each marker, trimmed, without quotes around it."""
    bare = strip(F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"(?s)<think>.*$", ""))
    behind = lambda acc, marker: F.when(F.contains(acc, marker), strip(F.call_function("substring_index", acc, marker, F.lit(-1)))).otherwise(acc)
    return F.regexp_replace(strip(F.aggregate(F.array(*map(F.lit, MARKERS)), bare, behind)), r'^"+|"+$', "")


def json_object(text: Column) -> Column:
    """A JSON object in the text, as text: all of it without code fences, else its widest {...}; null if neither parses."""
    bare = strip(F.regexp_replace(strip(F.regexp_replace(strip(text), r"(?i)^```(?:json)?", "")), r"```$", ""))
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    parsed = lambda c: F.try_parse_json(F.when(c != "", c))
    return F.when(parsed(bare).isNotNull(), bare).when(parsed(inner).isNotNull(), inner)


@pandas_udf(T.ArrayType(T.StructType([T.StructField(x, T.StringType()) for x in ("id", "winner", "reason")])))
def verdicts(s: pd.Series) -> pd.Series:
    """The first decodable JSON list of objects (or object) in each text: id, winner in canonical case, reason; first of each id.

    Entries with another winner are left out. Null and texts without such a list give an empty list.
    """
    names = {"a": "A", "b": "B", "tie": "Tie", "uncertain": "Uncertain"}

    def one(text: str | None) -> list[dict]:
        decoder = json.JSONDecoder()
        for m in re.finditer(r"[\[{]", text or ""):
            try:
                value, _ = decoder.raw_decode(text[m.start() :])
            except ValueError:
                continue
            value = [value] if isinstance(value, dict) else value
            if isinstance(value, list) and all(isinstance(v, dict) for v in value):
                break
        else:
            return []
        found: dict[str, dict] = {}
        for v in value:
            winner = str(v.get("winner", "")).strip()
            winner = names.get(winner.lower(), winner)
            if winner in names.values() and v.get("id") is not None:
                found.setdefault(str(v["id"]), {"id": str(v["id"]), "winner": winner, "reason": str(v.get("reason", ""))})
        return list(found.values())

    return s.map(one)


def last_paragraph(text: Column) -> Column:
    """The last paragraph that isn't blank; the trimmed text if there is none; empty for null."""
    parts = F.filter(F.split(strip(F.coalesce(text, F.lit(""))), "\n\n"), lambda p: strip(p) != "")
    return F.coalesce(strip(F.element_at(F.when(F.size(parts) > 0, parts), -1)), strip(F.coalesce(text, F.lit(""))))


def approx_tokens(text: Column) -> Column:
    """CJK characters + whole part of 1.3 x ASCII words + 8."""
    count = lambda p: F.size(F.regexp_extract_all(text, F.lit(f"({p})"), 1))
    return (count(_CJK) + F.floor(count("[A-Za-z0-9]+") * F.lit(1.3)) + 8).cast("int")


def strip_prefix(text: Column) -> Column:
    """What stands behind the first colon, trimmed; all of it without a colon."""
    return strip(F.regexp_replace(text, r"(?s)^[^:]*:", ""))


def split_of_path(path: Column) -> Column:
    """train, dev or test by a path's last folder of such a name; null without one."""
    return F.nullif(F.regexp_extract(path, r".*(?:^|/)(train|dev|test)(?:/|$)", 1), F.lit(""))


def id_part(exp_id: Column) -> Column:
    """What stands between the second and the last part of an id a/b/.../z."""
    parts = F.split(exp_id, "/")
    return F.when(F.size(parts) > 3, F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 3, F.lit(0))), "/")).otherwise(F.lit(""))


@udtf(returnType=T.StructType().add("path", T.StringType()).add("value", T.StringType()))
class JsonTexts:
    """All strings of a JSON value with their paths, in order of keys; broken JSON gives none."""

    def eval(self, text: str) -> Iterable[tuple[str, str]]:
        try:
            stack = [("$", json.loads(text))] if text is not None else []
        except ValueError:
            return
        while stack:
            path, value = stack.pop()
            if isinstance(value, str):
                yield path, value
            elif isinstance(value, dict):
                stack += [(f"{path}.{k}", value[k]) for k in sorted(value, reverse=True)]
            elif isinstance(value, list):
                stack += [(f"{path}[{i}]", value[i]) for i in reversed(range(len(value)))]


def example_block(index: Column, source: Column, draft: Column, advice: Column, final: Column, contrastive: bool = True) -> Column:
    """One example unit: heading, source, draft (if contrastive), last paragraph of the advice, result."""
    told = last_paragraph(advice)
    lines = [F.concat(F.lit("### Example "), index.cast("string")), F.concat(F.lit("Source: "), source)]
    lines += [F.concat(F.lit("Draft: "), draft)] if contrastive else []
    lines += [F.concat(F.lit("Critique & Advice: "), F.when(told == "", F.lit("(no advice given)")).otherwise(told)), F.concat(F.lit("Refined (Gold): "), final)]
    return F.concat_ws("\n", *lines)


def config_hash(fields: dict[str, Column], defaults: dict[str, object]) -> Column:
    """sha256 over name=value of the fields, by name; those at their default are left out, so that new fields change no old hash."""
    parts = [F.when(c.eqNullSafe(F.lit(defaults[k])), None).otherwise(F.concat(F.lit(f"{k}="), F.coalesce(c.cast("string"), F.lit("null")))) if k in defaults else F.concat(F.lit(f"{k}="), F.coalesce(c.cast("string"), F.lit("null"))) for k, c in sorted(fields.items())]
    return F.sha2(F.concat_ws(SEP, *parts), 256)


@pandas_udf(T.DoubleType())
def half_even(x: pd.Series, digits: pd.Series) -> pd.Series:
    """Rounding as Python's round() does it, from the binary value."""
    return pd.Series([None if pd.isna(v) else round(float(v), int(d)) for v, d in zip(x, digits)], dtype="float64")

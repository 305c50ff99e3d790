"""Decisions as CASE expressions: validity with reasons, acceptance gates, verdicts, labels, small closed formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.functions.text import json_object, norm, strip

_HAN = r"[\x{3400}-\x{9fff}]"


def outcome(reason: Column, ok: str = "valid") -> Column:
    """struct(valid, reason) from a reason that is null where nothing is wrong."""
    return F.struct(reason.isNull().alias("valid"), F.coalesce(reason, F.lit(ok)).alias("reason"))


def _marked(text: Column) -> Column:
    low = F.lower(text)
    return low.contains("<think>") | low.contains("</think>") | low.contains("```")


def format_reason(finish: Column, text: Column) -> Column:
    """Null or what is wrong: not stopped (the finish reason), empty, format."""
    return F.when(~finish.eqNullSafe(F.lit("stop")), F.coalesce(finish, F.lit("generation_failure"))).when(strip(F.coalesce(text, F.lit(""))) == "", F.lit("empty")).when(_marked(text), F.lit("format"))


def pair_reason(current: Column, candidate: Column, finish: Column, chinese: Column | None = None, overflow: Column | None = None, ratio: float = 1.5, allowance: int = 8, normalised: bool = True) -> Column:
    """Format first, then no_chinese (where asked), length over ratio x current + allowance, overflow.

    normalised compares lengths of normalised texts; without, raw lengths in built-in functions alone.
    """
    size = (lambda c: F.length(norm(c))) if normalised else F.length
    later = F.when((F.coalesce(current, F.lit("")) != "") & (size(candidate) > ratio * size(current) + allowance), F.lit("length"))
    if overflow is not None:
        later = F.coalesce(later, F.when(overflow, F.lit("context_overflow")))
    if chinese is not None:
        later = F.coalesce(F.when(chinese & ~candidate.rlike(_HAN), F.lit("no_chinese")), later)
    return F.coalesce(format_reason(finish, candidate), later)


def runtime_reason(before: Column, text: Column, finish: Column) -> Column:
    """The gate while generating: overflow, empty, unfinished, format, no_chinese (always), length, on the trimmed text."""
    t = strip(F.coalesce(text, F.lit("")))
    return (
        F.when(finish.eqNullSafe(F.lit("context_length_exceeded")), F.lit("context_length_exceeded"))
        .when(t == "", F.lit("empty"))
        .when(~finish.eqNullSafe(F.lit("stop")), F.lit("unfinished"))
        .when(_marked(t), F.lit("format"))
        .when(~t.rlike(_HAN), F.lit("no_chinese"))
        .when((F.coalesce(before, F.lit("")) != "") & (F.length(norm(t)) > 1.5 * F.length(norm(before)) + 8), F.lit("length"))
    )


def is_noop(current: Column, candidate: Column) -> Column:
    return current == candidate


def admissible(current: Column, candidate: Column, ratio: float = 1.5, allowance: int = 8) -> Column:
    """Not blank, changed, not too long."""
    return (strip(candidate) != "") & (candidate != current) & (F.length(candidate) <= ratio * F.length(current) + allowance)


def accepts(verdict: Column, consistent: Column, current: Column, candidate: Column, ratio: Column | float | None = None) -> Column:
    """Better in both orders and, with a ratio, no longer than ratio x the current text (1 at least)."""
    base = (verdict == "better") & consistent
    return base if ratio is None else base & (F.length(candidate) <= ratio * F.greatest(F.lit(1), F.length(current)))


def quality_gate(current: Column, candidate: Column, before: Column, after: Column, min_gain: float = 0.01, soft: float = 1.02, hard: float = 1.5, expansion_gain: float = 0.05, allowance: int = 8) -> Column:
    """struct(valid, reason). Non-finite scores are an error; the gain must be over min_gain, more where the text grows."""
    finite = ~(F.isnan(before) | F.isnan(after) | (F.abs(before) == float("inf")) | (F.abs(after) == float("inf")))
    gain, n = after - before, F.greatest(F.lit(1), F.length(current))
    reason = (
        F.when(~finite, F.raise_error(F.lit("nonfinite quality score")))
        .when((strip(candidate) == "") | (candidate == current), F.lit("empty_or_identical"))
        .when(gain <= min_gain, F.lit("insufficient_quality_gain"))
        .when(F.length(candidate) > hard * n + allowance, F.lit("hard_length_limit"))
        .when((F.length(candidate) > soft * n + allowance) & (gain <= expansion_gain), F.lit("expansion_without_strong_gain"))
    )
    return outcome(reason, "quality_gain")


def should_stop(score: Column, threshold: float) -> Column:
    return score > threshold


def negative(delta: Column, verdict: Column) -> Column:
    """By the measured delta where there is one, else by the verdict."""
    return F.coalesce(delta < 0, verdict == "worse")


def admitted(delta: Column, verdict: Column) -> Column:
    return ~negative(delta, verdict)


def decision(accept: Column, reject: Column) -> Column:
    """A tie rejects."""
    return F.when(accept > reject, F.lit("Accept")).otherwise(F.lit("Reject"))


def failed_checks(checks: Column) -> Column:
    """Of array<struct<name, verdict>> those whose verdict isn't YES."""
    return F.filter(checks, lambda x: F.upper(strip(x["verdict"])) != "YES")


def says_no_error(reply: Column) -> Column:
    return F.lower(F.coalesce(F.get_json_object(reply, "$.no_error"), F.lit("false"))) == "true"


def first_accepted(candidates: Column) -> Column:
    """Of array<struct<slot, text, decision>> the text of the first that is accepted; null if none is."""
    hits = F.filter(candidates, lambda x: x["decision"] == "Accept")
    return F.get(hits, F.lit(0))["text"]


def best_by_margin(candidates: Column, margin: float) -> Column:
    """Of array<struct<slot, text, better, tie, worse>> the text of the best that leads by the margin: largest margin, then better, then lowest slot."""
    led = F.filter(candidates, lambda x: (x["better"] > F.greatest(x["tie"], x["worse"])) & (x["better"] - x["worse"] >= margin))
    keyed = F.transform(led, lambda x: F.struct((x["better"] - x["worse"]).alias("lead"), x["better"].alias("better"), (-x["slot"]).alias("back"), x["text"].alias("text")))
    return F.array_max(keyed)["text"]


def winner(raw: Column, reverse: Column, low: tuple[str, str, str, str] = ("better", "worse", "tie", "uncertain")) -> Column:
    """A judgment of A against B, where reverse puts the candidate first: about the candidate."""
    v = F.upper(strip(raw))
    better, worse, tie, uncertain = map(F.lit, low)
    return F.when(v.isin("A", "B"), F.when((v == "A") == reverse, better).otherwise(worse)).when(v == "TIE", tie).otherwise(uncertain)


def combine_strict(first: Column, second: Column) -> Column:
    """Both orders must say the same; a missing one is uncertain."""
    return F.when(first.eqNullSafe(second) & first.isNotNull(), first).otherwise(F.lit("Uncertain"))


def combine_soft(first: Column, second: Column) -> Column:
    """As strict, but one preference and one tie make a tie."""
    a, b = F.coalesce(first, F.lit("uncertain")), F.coalesce(second, F.lit("uncertain"))
    return F.when((a == "uncertain") | (b == "uncertain"), F.lit("uncertain")).when(a == b, a).when((a != "tie") & (b != "tie"), F.lit("uncertain")).otherwise(F.lit("tie"))


def controller_action(reply: Column, fixed: bool = False) -> Column:
    """struct(action, instruction, reason, failure) of a JSON reply: an unknown action refines if it has an instruction, no JSON stops."""
    obj = json_object(reply)
    field = lambda name: strip(F.coalesce(F.get_json_object(obj, f"$.{name}"), F.lit("")))
    failed = obj.isNull() | F.get_json_object(obj, "$.action").isNull()
    action = F.lit("REFINE") if fixed else F.when(F.upper(field("action")).isin("REFINE", "STOP"), F.upper(field("action"))).when(field("instruction") != "", F.lit("REFINE")).otherwise(F.lit("STOP"))
    blank = F.lit("")
    return F.struct(F.when(failed, F.lit("STOP")).otherwise(action).alias("action"), F.when(failed, blank).otherwise(field("instruction")).alias("instruction"), F.when(failed, F.lit("structured output failed after one repair retry")).otherwise(field("reason")).alias("reason"), failed.alias("failure"))


def label(delta: Column, epsilon: float = 0.0) -> Column:
    """Accept over epsilon, else Reject; non-finite deltas are an error, null stays null."""
    bad = F.isnan(delta) | (F.abs(delta) == float("inf"))
    return F.when(bad, F.raise_error(F.lit("nonfinite delta"))).when(delta > epsilon, F.lit("Accept")).when(delta.isNotNull(), F.lit("Reject"))


def label3(delta: Column, epsilon: float, names: tuple[str, str, str] = ("worse", "tie", "better")) -> Column:
    """Below -epsilon, within, above epsilon."""
    return F.when(delta < -epsilon, F.lit(names[0])).when(delta > epsilon, F.lit(names[2])).when(delta.isNotNull(), F.lit(names[1]))


def helped(delta: Column) -> Column:
    return label3(delta, 1e-9, ("hurt", "unchanged", "helped"))


def swapped(current: str, candidate: str, delta: str) -> list[Column]:
    """The same pair the other way round, labelled anew."""
    back = -F.col(delta)
    return [F.col(candidate).alias(current), F.col(current).alias(candidate), back.alias(delta), label(back).alias("label")]


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    """Of an array, shifted by its maximum."""
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp((x - top) / temperature))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, y: a + y))


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> Column:
    """struct(low, high) of a share's 95 % interval; null for no trials."""
    p, zz = hits / n, z * z
    centre, spread = p + zz / (2 * n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    return F.when(n > 0, F.struct(((centre - spread) / (1 + zz / n)).alias("low"), ((centre + spread) / (1 + zz / n)).alias("high")))


def rounds_allowed(utility: Column, ratio: Column, threshold: float) -> Column:
    """More rounds for a low first score or an odd length."""
    return F.when(utility >= threshold, 0).when(utility < threshold * 0.55, 3).when((ratio < 0.25) | (ratio > 2.5), 2).otherwise(1)


def utility(label_: Column) -> Column:
    return F.when(label_ == "Better", 1).when(label_ == "Worse", -1).otherwise(0)


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def saturation(tf: Column, length: Column, mean: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.greatest(mean, F.lit(1e-9))))


def cosine(a: Column, b: Column) -> Column:
    """Dot product over the norms of two arrays; 0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def rank_fusion(lexical: Column, dense: Column, weight: float, k: int = 60) -> Column:
    return (1 - weight) / (k + lexical) + weight / (k + dense)

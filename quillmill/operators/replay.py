"""Replay of revision rounds: folds where the state decides, windows where it doesn't, sums over nested rounds.

A trace is a row with ``initial_draft`` and ``rounds``, an array of structs in order with at least round_index,
controller_action, candidate, judge_verdict, judge_order_consistent, accepted, metric_offline.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions import rules
from quillmill.functions.text import strip


def _accepts(cur: Column, r: Column, ratio: Column | float | None) -> Column:
    return (r["controller_action"] == "REFINE") & F.coalesce(rules.accepts(r["judge_verdict"], r["judge_order_consistent"], cur, r["candidate"], ratio), F.lit(False))


def replay(traces: DataFrame, ratio: Column | float | None = None) -> DataFrame:
    """Adds replayed(final, n_rounds, n_accepted): what a length ratio would have accepted, each candidate against the text then current."""
    start = F.struct(F.col("initial_draft").alias("final"), F.lit(0).alias("n_rounds"), F.lit(0).alias("n_accepted"))

    def step(acc: Column, r: Column) -> Column:
        ok = _accepts(acc["final"], r, ratio)
        return F.struct(F.when(ok, r["candidate"]).otherwise(acc["final"]).alias("final"), (acc["n_rounds"] + (r["controller_action"] == "REFINE").cast("int")).alias("n_rounds"), (acc["n_accepted"] + ok.cast("int")).alias("n_accepted"))

    return traces.withColumn("replayed", F.aggregate("rounds", start, step))


def replay_many(traces: DataFrame, ratio: float = 1.02) -> DataFrame:
    """Adds replays(stored, gated, oracle, best): by the stored verdicts, with the length gate, and the best candidate there was.

    One fold carries all states. oracle starts from initial_metric_offline (null counts 0) and changes only for more.
    """
    start = F.struct(F.col("initial_draft").alias("stored"), F.col("initial_draft").alias("gated"), F.col("initial_draft").alias("oracle"), F.coalesce("initial_metric_offline", F.lit(0.0)).alias("best"))

    def step(acc: Column, r: Column) -> Column:
        more = (r["controller_action"] == "REFINE") & (r["metric_offline"] > acc["best"])
        keep = lambda name, cond, new: F.when(cond, new).otherwise(acc[name]).alias(name)
        return F.struct(keep("stored", _accepts(acc["stored"], r, None), r["candidate"]), keep("gated", _accepts(acc["gated"], r, ratio), r["candidate"]), keep("oracle", F.coalesce(more, F.lit(False)), r["candidate"]), keep("best", F.coalesce(more, F.lit(False)), r["metric_offline"]))

    return traces.withColumn("replays", F.aggregate("rounds", start, step))


def transitions(traces: DataFrame, only_improving: bool = False) -> DataFrame:
    """A row a REFINE round: before (the text current then), candidate, accepted, delta. Rejected candidates change no state."""
    unit = "struct<round_index:int,before:string,candidate:string,accepted:boolean,delta:double>"
    start = F.struct(F.col("initial_draft").alias("cur"), F.array().cast(f"array<{unit}>").alias("out"))

    def step(acc: Column, r: Column) -> Column:
        new = F.struct(r["round_index"].cast("int").alias("round_index"), acc["cur"].alias("before"), r["candidate"].alias("candidate"), r["accepted"].alias("accepted"), r["delta_offline"].cast("double").alias("delta"))
        refine = r["controller_action"] == "REFINE"
        return F.struct(F.when(refine & r["accepted"], r["candidate"]).otherwise(acc["cur"]).alias("cur"), F.when(refine, F.concat(acc["out"], F.array(new))).otherwise(acc["out"]).alias("out"))

    out = traces.select("sample_id", F.explode(F.aggregate("rounds", start, step, lambda a: a["out"])).alias("u")).select("sample_id", "u.*")
    return out.where(F.col("accepted") & (F.col("delta") > 0)) if only_improving else out


def prefix(traces: DataFrame, k: int) -> DataFrame:
    """The trace as a run of k rounds would have left it: rounds, final_output, final_metric_offline, cost of the last round kept."""
    kept = traces.withColumn("rounds", F.slice("rounds", 1, k)) if k else traces.withColumn("rounds", F.slice("rounds", 1, 0))
    start = F.struct(F.col("initial_draft").alias("text"), F.col("initial_metric_offline").alias("metric"))

    def step(acc: Column, r: Column) -> Column:
        took = (r["controller_action"] == "REFINE") & (F.coalesce(r["candidate"], F.lit("")) != "") & r["accepted"]
        return F.struct(F.when(took, r["candidate"]).otherwise(acc["text"]).alias("text"), F.when(took, F.coalesce(r["metric_offline"], acc["metric"])).otherwise(acc["metric"]).alias("metric"))

    state = F.aggregate("rounds", start, step)
    out = kept.withColumn("final_output", state["text"]).withColumn("final_metric_offline", state["metric"])
    return out.withColumn("cost", F.element_at(F.when(F.size("rounds") > 0, F.col("rounds")), -1)["cost"]) if "cost" in traces.schema["rounds"].dataType.elementType.names else out


def chain_violations(traces: DataFrame) -> DataFrame:
    """Adds violations: codes of rounds whose ``before`` isn't the text then current, rounds behind a STOP, a final text that isn't the last state."""
    start = F.struct(F.col("initial_draft").alias("cur"), F.lit(False).alias("stopped"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, r: Column) -> Column:
        codes = F.filter(F.array(F.when(r["before"] != acc["cur"], F.lit("before")), F.when(acc["stopped"], F.lit("after_stop"))), lambda x: x.isNotNull())
        return F.struct(F.when((r["controller_action"] == "REFINE") & r["accepted"], r["candidate"]).otherwise(acc["cur"]).alias("cur"), (acc["stopped"] | (r["controller_action"] == "STOP")).alias("stopped"), F.concat(acc["out"], codes).alias("out"))

    done = lambda a: F.concat(a["out"], F.when(F.col("final_output") != a["cur"], F.array(F.lit("final"))).otherwise(F.array().cast("array<string>")))
    return traces.withColumn("violations", F.aggregate("rounds", start, step, done))


def record_violations(records: DataFrame, temperatures: list[float]) -> DataFrame:
    """Adds violations, in order: codes of what a collected record breaks.

    A record has ``source_hash`` against ``source``, and ``candidates`` array<struct<slot, request, request_hash, prompt,
    seed, temperature>>. request: a hash that isn't the request's; count: not one candidate a planned temperature;
    temperature: not the planned one of its slot; seed: two candidates with one seed; prompt: two different prompts;
    source: another source than recorded. Null candidates count as none.
    """
    c = F.coalesce("candidates", F.slice("candidates", 1, 0), F.array().cast(records.schema["candidates"].dataType))
    planned = F.array(*map(F.lit, temperatures))
    distinct = lambda f: F.size(F.array_distinct(F.transform(c, f)))
    codes = [
        (F.sha2("source", 256) != F.col("source_hash"), "source"),
        (F.size(c) != len(temperatures), "count"),
        (F.exists(c, lambda x: F.sha2(x["request"], 256) != x["request_hash"]), "request"),
        (F.exists(c, lambda x: F.coalesce(x["temperature"] != F.get(planned, x["slot"]), F.lit(True))), "temperature"),
        (distinct(lambda x: x["seed"]) < F.size(c), "seed"),
        (distinct(lambda x: x["prompt"]) > 1, "prompt"),
    ]
    return records.withColumn("violations", F.filter(F.array(*[F.when(broken, F.lit(name)) for broken, name in codes]), lambda x: x.isNotNull()))


def flatten_candidates(states: DataFrame) -> DataFrame:
    """sample_id, state_index, before, slot, candidate, valid, identical of states(sample_id, states array<struct<before, candidates array<struct>>>)."""
    s = states.select("sample_id", F.posexplode("states").alias("state_index", "s"))
    c = s.select("sample_id", "state_index", F.col("s.before").alias("before"), F.posexplode("s.candidates").alias("slot", "c"))
    return c.select("sample_id", "state_index", "before", "slot", F.col("c.text").alias("candidate"), (F.col("c.text") == F.col("before")).alias("identical")).withColumn("valid", (strip(F.col("candidate")) != "") & ~F.col("identical"))


def state_before(rounds: DataFrame, by: str, order: str) -> DataFrame:
    """Adds before: the last accepted candidate of earlier rounds, else the draft. A window: acceptance is stored, not decided."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rounds.withColumn("before", F.coalesce(F.last(F.when(F.col("accepted"), F.col("candidate")), ignorenulls=True).over(w), F.col("initial_draft")))


def run_table(rounds: DataFrame, run: list[str]) -> DataFrame:
    """Per run: samples, rounds, refinements, accepts and their ratios, as ratios of sums."""
    out = rounds.groupBy(*run).agg(F.count_distinct("sample_id").alias("n_samples"), F.count(F.lit(1)).alias("n_rounds"), F.count_if(F.col("action") == "REFINE").alias("n_refine"), F.count_if("accepted").alias("n_accepted"), F.sum("cost").alias("cost"))
    return out.withColumn("accept_rate", F.try_divide("n_accepted", "n_refine")).withColumn("mean_rounds", F.col("n_rounds") / F.col("n_samples")).withColumn("cost_per_sample", F.col("cost") / F.col("n_samples"))


def pooled(counters: DataFrame, scope: list[str], counts: list[str]) -> DataFrame:
    """Counters summed over a wider scope; rates come from the sums, never from rates."""
    return counters.groupBy(*scope).agg(*[F.sum(c).alias(c) for c in counts])


def step_changes(values: DataFrame, by: str, order: str, value: str, epsilon: float = 1e-4) -> DataFrame:
    """One row: share of steps that improve, degrade or tie against the step before."""
    d = F.col(value) - F.lag(value).over(Window.partitionBy(by).orderBy(order))
    s = values.withColumn("__d", d).where("__d is not null")
    n = F.count(F.lit(1))
    return s.agg(n.alias("n_steps"), (F.count_if(F.col("__d") > epsilon) / n).alias("improve"), (F.count_if(F.col("__d") < -epsilon) / n).alias("degrade"), (F.count_if(F.abs("__d") <= epsilon) / n).alias("tie"))


def oracle_stop(traces: DataFrame, scores: str) -> DataFrame:
    """Adds first, last, best, best_at (first place of the best, from 0), wasted (steps behind it) of an array of scores."""
    s = F.col(scores)
    best = F.array_max(s)
    at = (F.array_position(s, best) - 1).cast("int")
    return traces.withColumns({"first": F.get(s, F.lit(0)), "last": F.element_at(F.when(F.size(s) > 0, s), -1), "best": best, "best_at": at, "wasted": (F.size(s) - 1 - at).cast("int")})


def unnecessary(rounds: DataFrame, by: list[str]) -> DataFrame:
    """Per group: scored refinements that made it worse, over those scored; null without any."""
    scored = F.count("delta")
    return rounds.groupBy(*by).agg(scored.alias("n_scored"), F.count_if(F.col("delta") < 0).alias("n_worse")).withColumn("rate", F.try_divide("n_worse", "n_scored"))


def complete_mean(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Per group the mean, null if any row lacks the value."""
    return df.groupBy(*by).agg(F.when(F.count(value) == F.count(F.lit(1)), F.avg(value)).alias("mean"))


def distinct_per_round(candidates: DataFrame) -> DataFrame:
    """Adds n_distinct and all_identical of an array of texts ``candidates``."""
    n = F.size(F.array_distinct("candidates"))
    return candidates.withColumn("n_distinct", n).withColumn("all_identical", n == 1)


def array_costs(runs: DataFrame) -> DataFrame:
    """Adds total and sequential tokens of ``generations`` array<struct<input_tokens, output_tokens>>: all, and those at ``sequential`` (or an override)."""
    each = lambda g: g["input_tokens"] + g["output_tokens"]
    total = F.aggregate("generations", F.lit(0).cast("long"), lambda a, g: a + each(g))
    picked = F.aggregate("sequential", F.lit(0).cast("long"), lambda a, i: a + each(F.get("generations", i)))
    return runs.withColumn("total_tokens", total).withColumn("sequential_tokens", F.coalesce("override", picked))


def verifier_conflicts(df: DataFrame, key: list[str], decision: str) -> DataFrame:
    """Inputs that got more than one decision."""
    return df.groupBy(*key).agg(F.count_distinct(decision).alias("n_decisions"), F.count(F.lit(1)).alias("n")).where("n_decisions > 1")


def admitted_memories(pairs: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Positive pairs that aren't known yet, one a key."""
    return pairs.where(F.col("delta") > 0).dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def mismatch(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.max(F.abs(F.col(a) - F.col(b))).alias("max_mismatch"), F.count(F.lit(1)).alias("n"))


def two_order_verdicts(calls: DataFrame) -> DataFrame:
    """pair_id, verdict of calls(pair_id, reverse, raw, repaired): the repaired reply if there is one, both orders combined; identical pairs tie."""
    v = calls.withColumn("v", rules.winner(F.coalesce("repaired", "raw"), F.col("reverse")))
    both = v.groupBy("pair_id").agg(F.max(F.when(~F.col("reverse"), F.col("v"))).alias("a"), F.max(F.when(F.col("reverse"), F.col("v"))).alias("b"), F.bool_or("identical").alias("identical"))
    return both.select("pair_id", F.when(F.col("identical"), "tie").otherwise(rules.combine_soft(F.col("a"), F.col("b"))).alias("verdict"))


def copeland(duels: DataFrame) -> DataFrame:
    """group, winner of duels(group, i, j, won), i < j, won null for a tie: most wins less losses, then who beat all tied, then the lowest."""
    sides = duels.select("group", F.explode(F.array(F.struct(F.col("i").alias("c"), F.when(F.col("won") == F.col("i"), 1).when(F.col("won") == F.col("j"), -1).otherwise(0).alias("s")), F.struct(F.col("j").alias("c"), F.when(F.col("won") == F.col("j"), 1).when(F.col("won") == F.col("i"), -1).otherwise(0).alias("s")))).alias("x")).select("group", "x.*")
    score = sides.groupBy("group", "c").agg(F.sum("s").alias("score"))
    tied = score.withColumn("top", F.max("score").over(Window.partitionBy("group"))).where("score = top").select("group", "c")
    n = tied.groupBy("group").agg(F.count(F.lit(1)).alias("n_tied"))
    t1, t2 = tied.withColumnRenamed("c", "i").withColumn("i_tied", F.lit(1)), tied.withColumnRenamed("c", "j").withColumn("j_tied", F.lit(1))
    among = duels.join(t1, ["group", "i"]).join(t2, ["group", "j"]).where(F.col("won").isNotNull()).groupBy("group", F.col("won").alias("c")).agg(F.count(F.lit(1)).alias("wins"))
    ranked = tied.join(n, "group").join(among, ["group", "c"], "left").withColumn("over_all", (F.coalesce("wins", F.lit(0)) == F.col("n_tied") - 1).cast("int"))
    return ranked.groupBy("group").agg(F.max_by("c", F.struct("over_all", -F.col("c"))).alias("winner"))

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from quillmill.operators import intervals as V
from quillmill.operators import isolation as I
from quillmill.operators import joins as J
from quillmill.operators import ordered as O
from quillmill.operators import replay as G
from quillmill.operators import retrieval as R
from quillmill.operators import sampling as S
from quillmill.operators import stats as St
from quillmill.operators.graph import pick

ROUND = "struct<round_index:int,controller_action:string,candidate:string,judge_verdict:string,judge_order_consistent:boolean,accepted:boolean,metric_offline:double,delta_offline:double,cost:int>"


def trace(spark, rounds, draft="A"):
    rows = [(i, "REFINE", c, "better" if ok else "worse", True, ok, m, m, i) for i, (c, ok, m) in enumerate(rounds)]
    return spark.createDataFrame([("s", draft, 0.0, rows)], f"sample_id string, initial_draft string, initial_metric_offline double, rounds array<{ROUND}>")


def test_rejected_candidates_change_no_state(spark):
    got = G.transitions(trace(spark, [("B", False, 1.0), ("C", True, 2.0)])).orderBy("round_index").collect()
    assert [(r.before, r.candidate) for r in got] == [("A", "B"), ("A", "C")]
    got = G.transitions(trace(spark, [("B", True, -1.0), ("C", True, 2.0)]), only_improving=True).collect()
    assert [(r.before, r.candidate) for r in got] == [("B", "C")]


def test_length_gate_depends_on_the_state(spark):
    t = trace(spark, [("x" * 30, True, 1.0), ("y" * 30, True, 1.0), ("z" * 12, True, 1.0)], "a" * 10)
    assert G.replay(t, 1.2).select("replayed.*").first().final == "z" * 12
    assert G.replay(t).select("replayed.*").first().n_accepted == 3


def test_replays_and_prefix(spark):
    t = trace(spark, [("BB", True, 1.0), ("C" * 40, True, 3.0), ("D", False, 2.0)], "A")
    r = G.replay_many(t).select("replays.*").first()
    assert (r.stored, r.gated, r.oracle, r.best) == ("C" * 40, "A", "C" * 40, 3.0)
    p = G.prefix(t, 1).first()
    assert (p.final_output, p.final_metric_offline, p.cost, len(p.rounds)) == ("BB", 1.0, 0, 1)
    assert G.prefix(t, 0).first().final_output == "A"


def test_quota_equals_the_greedy_walk(spark):
    rng = random.Random(5)
    rows = [(q, d, rng.choice("xyz"), rng.randint(0, 4) / 4) for q in range(12) for d in range(rng.randint(1, 9))]
    got = R.quota_top_k(spark.createDataFrame(rows, "query int, doc int, class string, score double"), 4).orderBy("query", "place").collect()
    for q in range(12):
        mine = sorted([r for r in rows if r[0] == q], key=lambda r: (-r[3], -r[1]))
        first, rest, seen = [], [], {}
        for r in mine:
            seen[r[2]] = seen.get(r[2], 0) + 1
            (first if seen[r[2]] <= 2 else rest).append(r[1])
        assert [x.doc for x in got if x["query"] == q] == (first + rest)[:4]


def test_min_max_of_equal_scores(spark):
    assert R.min_max(spark.createDataFrame([(1, 7, 2.0)], "query int, doc int, raw double")).first().norm == 1.0


def test_interval_union(spark):
    df = spark.createDataFrame([("g", a, b) for a, b in ((0.0, 10.0), (1.0, 9.0), (8.0, 12.0), (20.0, 23.0))], "g string, a double, b double")
    r = V.union_length(df, ["g"], "a", "b").first()
    assert (r.active, r.span, r.sessions) == (15.0, 23.0, 4)


def test_horizon(spark):
    rows = [(1128, 7598, 100000, 6000), (5000, 100000, 100000, 5000), (128, 0, 1000, 1000), (0, 0, 100, 100)]
    df = spark.createDataFrame(rows, "frontier int, retained int, total int, want int")
    assert all(r.horizon == r.want for r in V.required_horizon(df, "frontier", "retained", "total").collect())
    with pytest.raises(ValueError):
        V.required_horizon(df, "frontier", "retained", "total", most=0)
    assert [list(r.c) for r in df.limit(1).select(V.checkpoints(F.lit(10), 4).alias("c")).collect()] == [[0, 4, 8, 10]]
    assert [list(r.c) for r in df.limit(1).select(V.checkpoints(F.lit(8), 4).alias("c")).collect()] == [[0, 4, 8]]


def test_horizon_is_enough_and_needed(spark):
    """Random states: sources up to the horizon may suffice, those before its last shard can't."""
    rng = random.Random(11)
    rows = [(k, rng.randint(0, 3000), rng.randint(0, 900), rng.choice([90, 700, 1500, 3000])) for k in range(60)]
    rows = [(k, min(f, t), r, t) for k, f, r, t in rows]
    df = spark.createDataFrame(rows, "id int, frontier int, retained int, total int")
    knobs = {"initial": 1000, "size": 250, "pilot": 100}
    found = {}
    for s in V.shards(df, "total", **knobs).orderBy("start").collect():
        found.setdefault(s.id, []).append((s.start, s.stop))
    for r in V.required_horizon(df, "frontier", "retained", "total", target=800, most=2, **knobs).collect():
        cuts = found.get(r.id, [])
        assert all(a[1] == b[0] for a, b in zip(cuts, cuts[1:])) and (not cuts or (cuts[0][0], cuts[-1][1]) == (100, r.total)) and all(b - a <= 250 for a, b in cuts)
        least = min(1000, r.total)
        if r.frontier >= least and r.retained >= 800:
            assert r.horizon == r.frontier
        else:
            may = lambda stop: stop >= least and (stop >= r.total or r.retained + 2 * (stop - r.frontier) >= 800)
            assert r.horizon >= r.frontier and (may(r.horizon) or r.horizon == r.total)
            assert not any(may(stop) for _, stop in cuts if r.frontier <= stop < r.horizon)


def test_dense_in_blocks(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)] if i else [0.0] * 6) for i in range(50)]
    lib = spark.createDataFrame(rows, "doc int, v array<double>")
    queries = lib.where("doc % 7 = 0").withColumnRenamed("doc", "query")
    for shipped, block in ((1 << 20, 1024), (0, 5)):
        monkeypatch.setattr(R, "SHIPPED_BYTES", shipped)
        monkeypatch.setattr(R, "BLOCK_ROWS", block)
        got = {(r["query"], r.doc): r.cos for r in R.dense(queries, lib, "v").collect()}
        assert len(got) == 8 * 50 and {got[0, i] for i in range(50)} == {0.0}
        for (a, b), c in got.items():
            x, y = rows[a][1], rows[b][1]
            norm = math.hypot(*x) * math.hypot(*y)
            assert c == pytest.approx(sum(p * q for p, q in zip(x, y)) / norm if norm else 0.0)
        assert {k for k, c in got.items() if c >= 0.3} == {(r["query"], r.doc) for r in R.dense(queries, lib, "v", 0.3).collect()}


def test_bootstrap_of_equal_models_and_clusters(spark):
    rows = spark.createDataFrame([(m, c, x) for m in ("p", "q") for c, x in (("one", 1), ("one", 1), ("two", 0))], "model string, cluster string, correct int")
    d = St.paired_model_differences(rows, "model", "cluster", 40, 1).first()
    assert (d.mean_diff, d.ci_low, d.ci_high) == (0.0, 0.0, 0.0)
    sums = rows.where("model = 'p'").groupBy("model", "cluster").agg(F.sum("correct").alias("correct"), F.count("*").alias("rows"))
    acc = St.resampled_sums(sums, ["model"], ["correct", "rows"], "cluster", 60, 3)
    assert {round(r.correct / r.rows, 9) for r in acc.collect()} == {0.0, round(2 / 3, 9), 1.0}


def test_holm_and_best_setting(spark):
    t = spark.createDataFrame([("f", 1, 0.01), ("f", 2, 0.04), ("f", 3, 0.03)], "f string, t int, p double")
    assert [r.p_adjusted for r in St.holm(t, ["f"], "p", "t").orderBy("t").collect()] == pytest.approx([0.03, 0.06, 0.06])
    b = spark.createDataFrame([(1.0, 1.1), (1.0000001, None), (1.0, 1.5)], "total double, tau double")
    assert St.best_setting(b, "total", "tau").first().tau == 1.5


def test_copeland(spark):
    duels = [("g", 0, 1, 0), ("g", 0, 2, 2), ("g", 1, 2, 1), ("h", 0, 1, None), ("k", 0, 1, 1), ("k", 0, 2, 0), ("k", 1, 2, None), ("k", 0, 3, 0), ("k", 1, 3, None), ("k", 2, 3, None)]
    got = {r["group"]: r.winner for r in G.copeland(spark.createDataFrame(duels, "group string, i int, j int, won int")).collect()}
    assert got == {"g": 0, "h": 0, "k": 1}


def test_allocation_redistributes(spark):
    rng = random.Random(2)
    for _ in range(4):
        avail = {f"c{i}": rng.randint(0, 9) for i in range(6)}
        budget = rng.randint(0, 40)
        got = S.allocate(spark.createDataFrame(list(avail.items()), "c string, n int"), "c", "n", budget).collect()
        shares = {r.c: r.share for r in got}
        assert sum(shares.values()) == min(budget, sum(avail.values()))
        assert all(0 <= shares[c] <= avail[c] for c in avail)
        spare = [shares[c] for c in avail if shares[c] < avail[c]]
        assert not spare or max(spare) - min(spare) <= 1


def test_spread(spark):
    got = spark.createDataFrame([(10,), (3,), (0,)], "n int").select(S.spread(F.col("n"), 4).alias("s")).collect()
    assert [list(r.s) for r in got] == [[0, 3, 6, 9], [0, 1, 2], []]


def test_running_totals_and_quantiles(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), rng.choice([None, *[x / 4 for x in range(9)]])) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, g string, x double").repartition(7)
    got = O.running(df, [F.col("id").desc()], {"n": F.lit(1).cast("long"), "s": F.col("id").cast("long")}).collect()
    assert len(got) == 200 and all((r.n, r.s) == (200 - r.id, sum(range(r.id, 200))) for r in got)
    assert {(r.id, r.at) for r in O.placed(df, [F.col("g"), F.col("id")], "at").collect()} == {(r[0], k) for k, r in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    each = {(r.g, r.id): r.at for r in O.placed(df, [F.col("id")], "at", ["g"]).collect()}
    assert each == {(g, i): k for g in "ab" for k, i in enumerate(r[0] for r in rows if r[1] == g)}
    assert sorted(r.at for r in O.placed(df, [F.col("id")], "at", ["x"]).where("x is null").collect()) == list(range(sum(r[2] is None for r in rows)))
    points = {"q0": 0.0, "q10": 0.1, "q50": 0.5, "q95": 0.95, "q100": 1.0}
    want = df.groupBy("g").agg(F.percentile("x", F.array(*map(F.lit, points.values()))).alias("q")).collect()
    found = {r.g: [r[name] for name in points] for r in O.quantiles(df, ["g"], "x", points).collect()}
    assert found == {r.g: pytest.approx(list(r.q)) for r in want}
    assert O.placed(df.where("id < 0"), [F.col("id")], "at").count() == O.quantiles(df.where("id < 0"), ["g"], "x", points).count() == 0
    assert [r.x for r in S.top_share(df.select("id", F.col("id").alias("x")), "x", "id", 0.011).orderBy("x").collect()] == [197, 198, 199]


def test_nearest_rank_is_not_interpolated(spark):
    xs = list(range(1, 22))
    r = St.nearest_rank(spark.createDataFrame([("g", float(x)) for x in xs], "g string, x double"), ["g"], "x").first()
    assert (r.nearest, r.median) == (float(xs[max(0, int(0.95 * 21) - 1)]), statistics.median(xs))


def test_bijection_and_alignment(spark):
    labels = spark.createDataFrame([("a", "Accept"), ("b", "Reject")], "id string, label string")
    good = spark.createDataFrame([("a", "Accept"), ("b", "Accept")], "id string, decision string")
    assert J.bijection(good, labels, "id").count() == 2
    for rows in ([("a", "Accept")], [("a", "Accept"), ("a", "Reject"), ("b", "Reject")]):
        with pytest.raises(Exception, match="not one to one"):
            J.bijection(spark.createDataFrame(rows, "id string, decision string"), labels, "id").collect()


def test_availability_over_rounds(spark):
    rows = [("s", 0, ["i"], ["i"], ["n"]), ("s", 1, ["i"], ["n"], []), ("s", 2, ["i"], ["z"], [])]
    got = J.available(spark.createDataFrame(rows, "s string, k int, initial array<string>, retrieved array<string>, admitted array<string>"), "s", "k").orderBy("k").collect()
    assert [r.missing for r in got] == [[], [], ["z"]]


def test_exclusion_by_either_key(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", None)], "id int, k1 string, k2 string")
    assert [r.id for r in I.exclude_either(df, "id", ["k1", "k2"], spark.createDataFrame([("y",)], "key string")).orderBy("id").collect()] == [1, 3]


def test_self_consistency():
    assert pick(["the cat sat", "the cat sat down", "a dog ran", "the cat sat"]) in (0, 3)
    assert pick(["only"]) == 0


def test_seeds_orders_and_dispatch(spark):
    import zlib

    from quillmill.functions import metrics as M
    from quillmill.functions import text as T
    from quillmill.operators import pairs as P
    from quillmill.sources import writers as W

    df = spark.createDataFrame([("abc",), ("é",)], "t string")
    assert [r.s for r in df.select(T.crc_seed(F.col("t"), 77).alias("s")).collect()] == [(zlib.crc32(t.encode()) ^ 77) % 2**31 for t in ("abc", "é")]
    rows, manifest = spark.createDataFrame([(i,) for i in range(4)], "id int"), spark.createDataFrame([(2, 0), (0, 1)], "id int, place int")
    assert [r.id for r in W.in_manifest_order(rows, manifest, "id", "place").collect()] == [2, 0, 1, 3]
    pairs = spark.createDataFrame([("a", "b"), ("a", "c")], "current string, candidate string")
    assert P.require_changed(pairs).count() == 2
    with pytest.raises(Exception, match="no-op"):
        P.require_changed(pairs.union(spark.createDataFrame([("x", "x")], pairs.schema))).collect()
    tasks = spark.createDataFrame([("wmt19_en_zh", "你好", "你好"), ("gigaword", "a b", "a c"), ("none", "a", "a")], "task string, r string, c string")
    assert [r.m for r in tasks.select(M.task_metric(F.col("task"), F.col("r"), F.col("c")).alias("m")).collect()][1:] == [0.5, 0.0]
    library = spark.createDataFrame([(i,) for i in range(5)], "id int")
    assert R.fingerprint(library, "id").first() == R.fingerprint(library.orderBy(F.col("id").desc()), "id").first() != R.fingerprint(library.limit(4), "id").first()

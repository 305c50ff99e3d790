"""Queries over rounds, arms and decisions: replay, aggregates, classification, resampling, intervals, joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmill.functions import rules
from quillmill.operators import intervals as V
from quillmill.operators import joins as J
from quillmill.operators import replay as G
from quillmill.operators import sampling as S
from quillmill.operators import stats as St
from quillmill.plans.bindings import ARMS, DECISIONS, DRAW, ROUNDS, arms, decisions, rounds, traces
from quillmill.plans.registry import query
from quillmill.sources.readers import table


@query(f"""WITH {ROUNDS}, g AS (SELECT sample_id % 5 AS run, count(DISTINCT sample_id) AS n_samples, count(*) AS n_rounds, count_if(action = 'REFINE') AS n_refine, count_if(accepted) AS n_accepted, CAST(sum(cost) AS BIGINT) AS cost FROM r GROUP BY 1)
SELECT *, n_accepted / CAST(nullif(n_refine, 0) AS DOUBLE) AS accept_rate, n_rounds / CAST(n_samples AS DOUBLE) AS mean_rounds, cost / CAST(n_samples AS DOUBLE) AS cost_per_sample FROM g""", ["accept_rate", "mean_rounds", "cost_per_sample"])
def a7_run_table(spark, d):
    """A7, A8, A10."""
    return G.run_table(rounds(spark, d).withColumn("run", F.col("sample_id") % 5), ["run"])


@query(f"""WITH {ROUNDS}, g AS (SELECT sample_id % 5 AS run, count_if(action = 'STOP') AS stops, count_if(accepted AND delta < 0) AS worse, count_if(delta IS NULL) AS unscored FROM r GROUP BY sample_id % 5, sample_id)
SELECT run, CAST(sum(stops) AS BIGINT) AS stops, CAST(sum(worse) AS BIGINT) AS worse, CAST(sum(unscored) AS BIGINT) AS unscored FROM g GROUP BY run""")
def a12_pooled(spark, d):
    """Counters of samples pooled by run."""
    r = rounds(spark, d).withColumn("run", F.col("sample_id") % 5)
    each = r.groupBy("run", "sample_id").agg(F.count_if(F.col("action") == "STOP").alias("stops"), F.count_if(F.col("accepted") & (F.col("delta") < 0)).alias("worse"), F.count_if(F.col("delta").isNull()).alias("unscored"))
    return G.pooled(each, ["run"], ["stops", "worse", "unscored"])


@query(f"""WITH {ROUNDS} SELECT sample_id, round_index, coalesce(last_value(CASE WHEN accepted THEN candidate END IGNORE NULLS) OVER (PARTITION BY sample_id ORDER BY round_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), initial_draft) AS before FROM r""")
def w8_state_before(spark, d):
    """The text current before each round."""
    return G.state_before(rounds(spark, d), "sample_id", "round_index").select("sample_id", "round_index", "before")


@query(f"""WITH {ROUNDS}, w AS (SELECT *, coalesce(last_value(CASE WHEN accepted THEN candidate END IGNORE NULLS) OVER (PARTITION BY sample_id ORDER BY round_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), initial_draft) AS before FROM r)
SELECT sample_id, round_index, before, candidate, accepted, delta FROM w WHERE action = 'REFINE' AND accepted AND delta > 0""", ["delta"])
def g4_transitions(spark, d):
    """Improving transitions by a fold; the oracle takes a window, as stored acceptance decides."""
    return G.transitions(traces(spark, d), only_improving=True)


@query(f"""WITH RECURSIVE {ROUNDS}, s(sample_id, k, cur, n_rounds, n_accepted) AS (
SELECT DISTINCT sample_id, -1, 'draft', 0, 0 FROM r UNION ALL
SELECT s.sample_id, s.k + 1, CASE WHEN r.action = 'REFINE' AND r.event_type = 'purchase' AND length(r.candidate) <= 1.2 * greatest(1, length(s.cur)) THEN r.candidate ELSE s.cur END,
s.n_rounds + CAST(r.action = 'REFINE' AS INT), s.n_accepted + CAST(r.action = 'REFINE' AND r.event_type = 'purchase' AND length(r.candidate) <= 1.2 * greatest(1, length(s.cur)) AS INT)
FROM s JOIN r ON r.sample_id = s.sample_id AND r.round_index = s.k + 1)
SELECT sample_id, cur AS final, n_rounds, n_accepted FROM s QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY k DESC) = 1""")
def g1_replay(spark, d):
    """Acceptance against the text then current; the oracle recurses."""
    return G.replay(traces(spark, d), 1.2).select("sample_id", "replayed.*")


_GATED = "r.action = 'REFINE' AND r.event_type = 'purchase'"


@query(f"""WITH RECURSIVE {ROUNDS}, s(sample_id, k, stored, gated, oracle, best) AS (
SELECT DISTINCT sample_id, -1, 'draft', 'draft', 'draft', CAST(1 AS DOUBLE) FROM r UNION ALL
SELECT s.sample_id, s.k + 1, CASE WHEN {_GATED} THEN r.candidate ELSE s.stored END, CASE WHEN {_GATED} AND length(r.candidate) <= 1.02 * greatest(1, length(s.gated)) THEN r.candidate ELSE s.gated END,
CASE WHEN r.action = 'REFINE' AND r.value > s.best THEN r.candidate ELSE s.oracle END, CASE WHEN r.action = 'REFINE' AND r.value > s.best THEN r.value ELSE s.best END
FROM s JOIN r ON r.sample_id = s.sample_id AND r.round_index = s.k + 1)
SELECT sample_id, stored, gated, oracle, best FROM s QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY k DESC) = 1""", ["best"])
def g2_replay_many(spark, d):
    """Three replays and the best candidate in one fold; the oracle recurses, a test holds it against a loop."""
    return G.replay_many(traces(spark, d)).select("sample_id", "replays.*")


@query(f"""WITH {ROUNDS}, k AS (SELECT * FROM r WHERE round_index < 8)
SELECT sample_id, coalesce(max_by(candidate, round_index) FILTER (WHERE action = 'REFINE' AND accepted), 'draft') AS final_output, max_by(cost, round_index) AS cost, coalesce(max_by(value, round_index) FILTER (WHERE action = 'REFINE' AND accepted), 1.0) AS final_metric FROM k GROUP BY sample_id""", ["final_metric"])
def w9_prefix(spark, d):
    """What a run of eight rounds would have left."""
    return G.prefix(traces(spark, d), 8).select("sample_id", "final_output", "cost", F.col("final_metric_offline").alias("final_metric"))


@query(f"""WITH {ROUNDS} SELECT count(*) AS n_steps, count_if(delta > 1e-4) / CAST(count(*) AS DOUBLE) AS improve, count_if(delta < -1e-4) / CAST(count(*) AS DOUBLE) AS degrade, count_if(abs(delta) <= 1e-4) / CAST(count(*) AS DOUBLE) AS tie FROM r WHERE delta IS NOT NULL""", ["improve", "degrade", "tie"])
def a15_step_changes(spark, d):
    """A15, W7."""
    return G.step_changes(rounds(spark, d), "sample_id", "round_index", "value")


@query(f"""WITH {ROUNDS}, a AS (SELECT sample_id, list(value ORDER BY round_index) AS v FROM r GROUP BY sample_id)
SELECT sample_id, v[1] AS first, v[len(v)] AS last, list_max(v) AS best, CAST(list_position(v, list_max(v)) - 1 AS INT) AS best_at, CAST(len(v) - list_position(v, list_max(v)) AS INT) AS wasted FROM a""")
def a16_oracle_stop(spark, d):
    """A16, A53."""
    t = traces(spark, d).select("sample_id", F.transform("rounds", lambda r: r["metric_offline"]).alias("v"))
    return G.oracle_stop(t, "v").drop("v")


@query(f"""WITH {ROUNDS} SELECT action, count(delta) AS n_scored, count_if(delta < 0) AS n_worse, count_if(delta < 0) / CAST(nullif(count(delta), 0) AS DOUBLE) AS rate FROM r GROUP BY action""", ["rate"])
def a17_unnecessary(spark, d):
    """A17, A49."""
    return G.unnecessary(rounds(spark, d), ["action"])


@query(f"""WITH {ROUNDS} SELECT event_type, CASE WHEN count(delta) = count(*) THEN avg(delta) END AS mean FROM r GROUP BY event_type""", ["mean"])
def a18_complete_mean(spark, d):
    """A mean that is null if any row lacks the value."""
    return G.complete_mean(rounds(spark, d), ["event_type"], "delta")


@query(f"""WITH {ROUNDS} SELECT event_type, accepted, count(DISTINCT candidate) AS n_decisions, count(*) AS n FROM r GROUP BY 1, 2 HAVING count(DISTINCT candidate) > 1""")
def g11_conflicts(spark, d):
    """G11, A37."""
    return G.verifier_conflicts(rounds(spark, d), ["event_type", "accepted"], "candidate")


@query("""WITH i AS (SELECT event_type, epoch_us(ts) / 1000000.0 AS a, epoch_us(ts) / 1000000.0 + value AS b FROM events),
w AS (SELECT *, max(b) OVER (PARTITION BY event_type ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM i),
g AS (SELECT event_type, sum(greatest(0.0, b - greatest(a, coalesce(m, a)))) AS active, max(b) - min(a) AS span, count(*) AS sessions FROM w GROUP BY 1)
SELECT event_type, round(active, 3) AS active, round(span, 3) AS span, sessions, round(greatest(0.0, span - active), 3) AS inactive FROM g""")
def w14_interval_union(spark, d):
    """Length of the union of timing intervals."""
    e = table(spark, d, "events").select("event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("a")  , "value").withColumn("b", F.col("a") + F.col("value"))
    out = V.union_length(e, ["event_type"], "a", "b")
    return out.withColumns({c: F.round(c, 3) for c in ("active", "span", "inactive")})


@query(f"""WITH {ARMS}, a AS (SELECT sample_id, metric FROM arms WHERE arm = 'A'), b AS (SELECT sample_id, metric FROM arms WHERE arm = 'N'),
j AS (SELECT CASE WHEN b.sample_id IS NULL THEN 'only_a' WHEN a.sample_id IS NULL THEN 'only_b' ELSE 'both' END AS side, a.metric AS ma, b.metric AS mb FROM a FULL JOIN b USING (sample_id))
SELECT side, count(*) AS n, avg(ma - mb) AS mean_diff FROM j GROUP BY side""", ["mean_diff"])
def j3_paired(spark, d):
    """Both arms of a sample, and what either lacks."""
    x = arms(spark, d)
    p = J.paired(x.where("arm = 'A'"), x.where("arm = 'N'"), "sample_id", "metric")
    return p.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("a") - F.col("b")).alias("mean_diff"))


@query(f"""WITH {ARMS}, r AS (SELECT arm, sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY metric DESC, arm) AS rank FROM arms) SELECT arm, avg(rank) AS mean_rank, count(*) AS n FROM r GROUP BY arm""", ["mean_rank"])
def w10_mean_rank(spark, d):
    """W10."""
    w = Window.partitionBy("sample_id").orderBy(F.col("metric").desc(), "arm")
    return arms(spark, d).withColumn("rank", F.row_number().over(w)).groupBy("arm").agg(F.avg("rank").alias("mean_rank"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {ARMS}, s AS (SELECT arm, metric, row_number() OVER (PARTITION BY arm ORDER BY metric) AS rn, count(*) OVER (PARTITION BY arm) AS n FROM arms)
SELECT arm, avg(metric) AS mean, median(metric) AS median, max(CASE WHEN rn = greatest(1, CAST(floor(CAST(0.95 AS DOUBLE) * n) AS BIGINT)) THEN metric END) AS nearest FROM s GROUP BY arm""", ["mean", "median", "nearest"])
def a9_nearest_rank(spark, d):
    """Mean, median and the nearest-rank 95th percentile."""
    return St.nearest_rank(arms(spark, d), ["arm"], "metric")


@query(f"""WITH {DECISIONS}, g AS (SELECT model, count(*) AS n, count_if(decision = 'Accept' AND label = 'Accept') AS tp, count_if(decision = 'Accept' AND label <> 'Accept') AS fp, count_if(decision <> 'Accept' AND label = 'Accept') AS fn, count_if(decision <> 'Accept' AND label <> 'Accept') AS tn,
sum(CASE WHEN decision = 'Accept' THEN delta ELSE 0 END) AS gain FROM dec GROUP BY model)
SELECT model, n, tp, fp, fn, tn, (tp + tn) / n AS accuracy, tp / (tp + fp) AS accept_precision, tp / (tp + fn) AS accept_recall, (2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2 AS macro_f1, gain / n AS net_delta FROM g""", ["accuracy", "accept_precision", "accept_recall", "macro_f1", "net_delta"])
def a19_point_metrics(spark, d):
    """A19, A22, P27."""
    return St.point_metrics(decisions(spark, d), ["model"])


@query(f"""WITH {DECISIONS} SELECT model, avg(CAST(p > 0.5 AS DOUBLE)) AS coverage, avg(-ln(CASE WHEN y = 1 THEN p ELSE 1 - p END)) AS nll, avg(pow(p - y, 2)) AS brier, count_if(p > 0.5 AND y = 1) / CAST(count_if(p > 0.5) AS DOUBLE) AS precision FROM dec GROUP BY model""", ["coverage", "nll", "brier", "precision"])
def a20_probability_metrics(spark, d):
    """A20, A26."""
    return St.probability_metrics(decisions(spark, d), ["model"])


@query(f"""WITH {DECISIONS}, r AS (SELECT model, y, rank() OVER (PARTITION BY model ORDER BY p) + (count(*) OVER (PARTITION BY model, p) - 1) / 2.0 AS ar FROM dec)
SELECT model, (sum(CASE WHEN y = 1 THEN ar END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS auc FROM r GROUP BY model""", ["auc"])
def a24_auc(spark, d):
    """Area under the curve, ties half."""
    return St.auc(decisions(spark, d), ["model"], "p", "y")


@query(f"""WITH {DECISIONS}, r AS (SELECT model, rank() OVER (PARTITION BY model ORDER BY p) + (count(*) OVER (PARTITION BY model, p) - 1) / 2.0 AS a, rank() OVER (PARTITION BY model ORDER BY delta) + (count(*) OVER (PARTITION BY model, delta) - 1) / 2.0 AS b FROM dec)
SELECT model, corr(a, b) AS spearman FROM r GROUP BY model""", ["spearman"])
def a25_spearman(spark, d):
    """A25."""
    return St.spearman(decisions(spark, d), ["model"], "p", "delta")


@query(f"""WITH {DECISIONS}, b AS (SELECT model, least(CAST(floor(p * 15) AS INT), 14) AS bin, count(*) AS n, sum(p) AS c, sum(y) AS k FROM dec GROUP BY 1, 2) SELECT model, sum(abs(c - k)) / sum(n) AS ece FROM b GROUP BY model""", ["ece"])
def a21_calibration(spark, d):
    """Calibration error over 15 bins."""
    return St.calibration_error(decisions(spark, d), ["model"], "p", "y")


@query(f"""WITH {DECISIONS}, t AS (SELECT p AS threshold, count(*) AS n, sum(y) AS k FROM dec GROUP BY p),
c AS (SELECT threshold, CAST(sum(n) OVER w AS BIGINT) AS accepted, CAST(sum(k) OVER w AS BIGINT) AS hits FROM t WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING))
SELECT threshold, accepted, hits, hits / CAST(accepted AS DOUBLE) AS precision FROM c WHERE accepted >= 20 ORDER BY hits / CAST(accepted AS DOUBLE) DESC, accepted DESC LIMIT 1""", ["precision"])
def l13_best_threshold(spark, d):
    """Of all distinct scores the best inclusive threshold."""
    return St.best_threshold(decisions(spark, d), "p", "y")


@query(f"""WITH {DECISIONS}, g AS (SELECT model, sum(y) AS k, count(*) AS n FROM dec GROUP BY model), s AS (SELECT model, k / CAST(n AS DOUBLE) AS p, CAST(n AS DOUBLE) AS n, 1.959963984540054 AS z FROM g)
SELECT model, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n) AS low, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n) AS high FROM s""", ["low", "high"])
def f33_wilson(spark, d):
    """F33, A23."""
    g = decisions(spark, d).groupBy("model").agg(F.sum("y").alias("k"), F.count(F.lit(1)).alias("n"))
    return g.select("model", rules.wilson(F.col("k"), F.col("n")).alias("w")).select("model", "w.*")


@query(f"""WITH {ARMS}, p AS (SELECT sample_id % 4 AS grp, sample_id, a.metric AS x, b.metric AS y, a.metric - b.metric AS d, row_number() OVER (PARTITION BY sample_id % 4 ORDER BY sample_id) - 1 AS place, count(*) OVER (PARTITION BY sample_id % 4) AS n
  FROM (SELECT * FROM arms WHERE arm = 'A') a JOIN (SELECT * FROM arms WHERE arm = 'R') b USING (sample_id)),
g AS (SELECT grp, max(n) AS n, avg(x) AS mean_a, avg(y) AS mean_b, avg(d) AS diff FROM p GROUP BY grp),
rep AS (SELECT grp, b, {DRAW.format(seed=0)} AS place FROM g, range(2000) t(b), LATERAL (SELECT unnest(range(n)) AS i) u),
m AS (SELECT rep.grp, rep.b, sum(d) / max(p.n) AS m FROM rep JOIN p ON p.grp = rep.grp AND p.place = rep.place GROUP BY 1, 2),
l AS (SELECT m.grp, list(m ORDER BY m) AS s, least(1.0, 2.0 * count_if(CASE WHEN diff >= 0 THEN m <= 0 ELSE m >= 0 END) / 2000) AS p FROM m JOIN g USING (grp) GROUP BY m.grp)
SELECT grp, n, mean_a, mean_b, diff, s[50] AS ci_low, s[1951] AS ci_high, CAST(p AS DOUBLE) AS p FROM g JOIN l USING (grp)""", ["mean_a", "mean_b", "diff", "ci_low", "ci_high", "p"])
def t1_paired_bootstrap(spark, d):
    """Paired percentile bootstrap with draws by a counter hash."""
    x = arms(spark, d)
    a, b = x.where("arm = 'A'").select("sample_id", F.col("metric").alias("a")), x.where("arm = 'R'").select("sample_id", F.col("metric").alias("b"))
    pairs = a.join(b, "sample_id").withColumn("grp", F.col("sample_id") % 4)
    return St.paired_bootstrap(pairs, ["grp"], "a", "b", "sample_id", 2000, 0)


@query(f"""WITH {DECISIONS}, c AS (SELECT model, cluster, CAST(sum(CAST(decision = label AS INT)) AS BIGINT) AS correct, count(*) AS rows_ FROM dec GROUP BY 1, 2),
k AS (SELECT model, cluster, correct, rows_, row_number() OVER (PARTITION BY model ORDER BY cluster) - 1 AS place, count(*) OVER (PARTITION BY model) AS n FROM c),
s AS (SELECT max(n) AS n FROM k), rep AS (SELECT b, {DRAW.format(seed=5)} AS place FROM s, range(2000) t(b), LATERAL (SELECT unnest(range(n)) AS i) u),
x AS (SELECT model, b, sum(correct) / CAST(sum(rows_) AS DOUBLE) AS x FROM rep JOIN k USING (place) GROUP BY 1, 2)
SELECT model, quantile_cont(x, 0.025) AS ci_low, quantile_cont(x, 0.975) AS ci_high FROM x GROUP BY model""", ["ci_low", "ci_high"])
def t2_clustered_bootstrap(spark, d):
    """Accuracy intervals over resampled clusters, all models on the same draws."""
    rows = decisions(spark, d).select("model", "cluster", (F.col("decision") == F.col("label")).cast("long").alias("correct"))
    return St.clustered_intervals(rows, "model", "cluster", 2000, 5)


@query(f"""WITH {DECISIONS}, c AS (SELECT model, cluster, CAST(sum(CAST(decision = label AS INT)) AS BIGINT) AS correct, count(*) AS rows_ FROM dec GROUP BY 1, 2),
k AS (SELECT model, cluster, correct, rows_, row_number() OVER (PARTITION BY model ORDER BY cluster) - 1 AS place, count(*) OVER (PARTITION BY model) AS n FROM c),
s AS (SELECT max(n) AS n FROM k), rep AS (SELECT b, {DRAW.format(seed=5)} AS place FROM s, range(2000) t(b), LATERAL (SELECT unnest(range(n)) AS i) u),
x AS (SELECT model, b, sum(correct) / CAST(sum(rows_) AS DOUBLE) AS x FROM rep JOIN k USING (place) GROUP BY 1, 2),
d AS (SELECT f.model AS "first", g.model AS "second", f.x - g.x AS d FROM x f JOIN x g ON f.b = g.b AND f.model < g.model)
SELECT "first", "second", avg(d) AS mean_diff, quantile_cont(d, 0.025) AS ci_low, quantile_cont(d, 0.975) AS ci_high FROM d GROUP BY 1, 2""", ["mean_diff", "ci_low", "ci_high"])
def t3_model_differences(spark, d):
    """Paired differences between models over shared draws."""
    rows = decisions(spark, d).select("model", "cluster", (F.col("decision") == F.col("label")).cast("long").alias("correct"))
    return St.paired_model_differences(rows, "model", "cluster", 2000, 5)


@query(f"""WITH {DECISIONS}, cl AS (SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT cluster FROM dec)),
s AS (SELECT max(n) AS n FROM cl), rep AS (SELECT b, {DRAW.format(seed=7)} AS place FROM s, range(2000) t(b), LATERAL (SELECT unnest(range(n)) AS i) u),
m AS (SELECT b, place, count(*) AS times FROM rep GROUP BY 1, 2), c AS (SELECT model, place, p, sum(y) AS pos, sum(1 - y) AS neg FROM dec JOIN cl USING (cluster) GROUP BY 1, 2, 3),
e AS (SELECT model, b, p, sum(pos * times) AS pos, sum(neg * times) AS neg FROM c JOIN m USING (place) GROUP BY 1, 2, 3),
r AS (SELECT model, b, pos, neg, sum(neg) OVER (PARTITION BY model, b ORDER BY p) - neg AS below FROM e),
a AS (SELECT model, b, CAST(sum(pos * (below + neg / 2.0)) AS DOUBLE) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) AS auc FROM r GROUP BY 1, 2 HAVING sum(pos) > 0 AND sum(neg) > 0)
SELECT model, quantile_cont(auc, 0.025) AS ci_low, quantile_cont(auc, 0.975) AS ci_high, count(*) AS valid FROM a GROUP BY model""", ["ci_low", "ci_high"])
def t14_clustered_auc(spark, d):
    """The area under the curve over resampled clusters, ties by cumulative sums; replicates of one class left out."""
    return St.clustered_auc(decisions(spark, d).select("model", "cluster", "p", "y"), "model", "cluster", "p", "y", 2000, 7)


@query(f"""WITH {DECISIONS}, c AS (SELECT model, cluster, count(*) FILTER (WHERE y = 1 AND decision = 'Accept') AS tp, count(*) FILTER (WHERE y = 0 AND decision = 'Accept') AS fp, count(*) FILTER (WHERE y = 1 AND decision <> 'Accept') AS fn FROM dec WHERE p >= 0.1 GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY cluster) - 1 AS place, count(*) OVER (PARTITION BY model) AS n FROM c),
s AS (SELECT max(n) AS n FROM k), rep AS (SELECT b, {DRAW.format(seed=9)} AS place FROM s, range(2000) t(b), LATERAL (SELECT unnest(range(n)) AS i) u),
x AS (SELECT model, b, 2.0 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0) AS x FROM rep JOIN k USING (place) GROUP BY 1, 2)
SELECT model, quantile_cont(x, 0.025) AS ci_low, quantile_cont(x, 0.975) AS ci_high, count(x) AS valid FROM x GROUP BY model""", ["ci_low", "ci_high"])
def t5_clustered_f1(spark, d):
    """T5: F1 over resampled clusters, unresolved rows left out of each replicate."""
    x = decisions(spark, d).select("model", "cluster", "y", F.when(F.col("p") >= 0.1, (F.col("decision") == "Accept").cast("int")).alias("predicted"))
    return St.clustered_f1(x, "model", "cluster", "y", "predicted", 2000, 9)


@query(f"""WITH {ARMS}, t AS (SELECT arm, sample_id % 10 AS test, (CAST(round(avg(metric) * 100) AS BIGINT) % 100) / 1000.0 AS p FROM arms GROUP BY 1, 2),
s AS (SELECT *, (count(*) OVER (PARTITION BY arm) - row_number() OVER (PARTITION BY arm ORDER BY p, test) + 1) * p AS s, row_number() OVER (PARTITION BY arm ORDER BY p, test) AS rn FROM t)
SELECT arm, test, p, least(1.0, max(s) OVER (PARTITION BY arm ORDER BY rn)) AS p_adjusted FROM s""", ["p", "p_adjusted"])
def w13_holm(spark, d):
    """W13."""
    t = arms(spark, d).groupBy("arm", (F.col("sample_id") % 10).alias("test")).agg(((F.round(F.avg("metric") * 100).cast("long") % 100) / 1000).alias("p"))
    return St.holm(t, ["arm"], "p", "test")


@query(f"""WITH {ARMS}, m AS (SELECT sample_id % 7 AS o, avg(metric) AS m FROM arms GROUP BY 1) SELECT avg(m) AS mean, stddev_pop(m) AS std, count(*) AS n_orders FROM m""", ["mean", "std"])
def a41_order_variance(spark, d):
    """A41, A47."""
    return St.order_variance(arms(spark, d).withColumn("o", F.col("sample_id") % 7), "o", "metric")


@query(f"""WITH {DECISIONS}, g AS (SELECT unnest([0.5, 0.75, 1.0, 1.5, 2.0, 3.0]) AS t), z AS (SELECT CAST(t AS DOUBLE) AS t, CASE WHEN y = 1 THEN p - 0.5 ELSE 0.5 - p END / CAST(t AS DOUBLE) AS z FROM dec, g),
n AS (SELECT t, avg(ln(1 + exp(-abs(z))) + greatest(-z, 0.0)) AS nll FROM z GROUP BY t) SELECT t, nll FROM n ORDER BY round(nll, 12), t LIMIT 1""", ["nll"])
def t12_temperature(spark, d):
    """The best temperature of a grid."""
    return St.temperature(decisions(spark, d).select((F.col("p") - 0.5).alias("margin"), "y"), [0.5, 0.75, 1.0, 1.5, 2.0, 3.0])


@query(f"""WITH {ARMS}, s AS (SELECT arm, string_agg(sha256(CAST(CAST(round(metric * 100) AS BIGINT) AS VARCHAR)), ',' ORDER BY sample_id) AS l, count(*) AS n FROM arms WHERE sample_id IN (SELECT sample_id FROM arms GROUP BY sample_id HAVING count(DISTINCT arm) = (SELECT count(DISTINCT arm) FROM arms)) GROUP BY arm) SELECT arm, sha256(l) AS signature FROM s""")
def a36_signature(spark, d):
    """Ordered content signatures over all samples that every arm has."""
    x = arms(spark, d).withColumn("v", F.round(F.col("metric") * 100).cast("long"))
    return J.modal_signature(J.shared_keys(x, "arm", "sample_id"), "arm", "sample_id", "v").select("arm", "signature")


@query(f"""WITH {ARMS}, b AS (SELECT arm AS unit, min(sample_id) // 100 AS birth_batch FROM arms GROUP BY arm), r AS (SELECT arm AS unit, sample_id, sample_id // 100 AS batch FROM arms)
SELECT r.unit, count(*) AS n, count_if(birth_batch < batch) AS n_ok FROM r JOIN b USING (unit) GROUP BY 1""")
def j21_born_before(spark, d):
    """Units retrieved must be born in an earlier batch."""
    x = arms(spark, d).select(F.col("arm").alias("unit"), "sample_id", F.floor(F.col("sample_id") / 100).alias("batch"))
    births = x.groupBy("unit").agg(F.min("batch").alias("birth_batch"))
    return J.born_before(x, births, "unit").groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_ok"))


@query("""WITH c AS (SELECT o_custkey AS grp, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS idx FROM orders), f AS (SELECT * FROM c),
d AS (SELECT a.grp, a.idx AS i, b.idx AS j, CASE WHEN a.o_totalprice > b.o_totalprice THEN a.idx ELSE b.idx END AS won FROM f a JOIN f b ON a.grp = b.grp AND a.idx < b.idx)
SELECT grp AS "group", arg_max(idx, o_totalprice) AS winner FROM f GROUP BY grp HAVING count(*) > 1""")
def w11_copeland(spark, d):
    """Round robin of all orders of a customer: the dearer wins, any price beats none; of the dearest the first wins."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    c = table(spark, d, "orders").select(F.struct("o_custkey").alias("group"), (F.row_number().over(w) - 1).cast("long").alias("idx"), "o_totalprice")
    p = J.all_pairs(c, "group", "idx", "o_totalprice")
    x, y = F.col("o_totalprice_i"), F.col("o_totalprice_j")
    won = F.when(x.isNotNull() & (y.isNull() | (x > y)), F.col("i")).when(y.isNotNull() & (x.isNull() | (y > x)), F.col("j"))
    priced = c.groupBy("group").agg(F.count("o_totalprice").alias("n_priced"))
    best = G.copeland(p.select("group", "i", "j", won.alias("won"))).join(priced, "group")
    return best.select(F.col("group.o_custkey").alias("group"), F.when(F.col("n_priced") > 0, F.col("winner")).alias("winner"))


@query("""WITH own AS (SELECT c_custkey AS id, c_acctbal < 0 AS running, c_mktsegment AS seg FROM customer WHERE c_custkey % 3 <> 0), ed AS (SELECT c_custkey AS id, upper(c_mktsegment) || '!' AS seg FROM customer WHERE c_custkey % 5 <> 0)
SELECT coalesce(own.id, ed.id) AS id, coalesce(own.running, false) AS running, CASE WHEN own.id IS NOT NULL AND (own.running OR ed.id IS NULL) THEN own.seg ELSE ed.seg END AS seg FROM own FULL JOIN ed ON own.id = ed.id WHERE ed.id IS NOT NULL OR own.running""")
def j29_merge_edits(spark, d):
    """New rows in, edits taken unless running, vanished rows out unless running."""
    c = table(spark, d, "customer")
    own = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") < 0).alias("running"), F.col("c_mktsegment").alias("seg"))
    edited = c.where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("id"), F.concat(F.upper("c_mktsegment"), F.lit("!")).alias("seg"))
    return J.merge_edits(own, edited, "id", "running", ["seg"])


@query("""WITH r AS (SELECT p_brand, p_type, p_partkey, p_size FROM part) SELECT p_brand, p_partkey, p_size FROM r QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) = 1""")
def a35_keep_fullest(spark, d):
    """Of duplicate runs the fullest, then the first."""
    p = table(spark, d, "part").select("p_brand", "p_partkey", "p_size")
    return J.keep_fullest(p, ["p_brand"], "p_size", "p_partkey").select("p_brand", "p_partkey", "p_size")


@query(f"""WITH {DECISIONS}, t AS (SELECT id, p, row_number() OVER (ORDER BY p DESC, id) AS rn, count(*) OVER () AS n FROM dec) SELECT id, p FROM t WHERE rn <= ceil(CAST(0.1 AS DOUBLE) * n)""")
def w24_top_share(spark, d):
    """The most confident tenth; the share is the operator."""
    return S.top_share(decisions(spark, d).select("id", "p"), "p", "id", 0.1)


@query("""WITH o AS (SELECT unnest([0, 1, 2]) AS "order"), x AS (SELECT o."order", s_suppkey, sha256('3' || chr(31) || o."order" || chr(31) || s_suppkey) AS h FROM supplier, o) SELECT CAST("order" AS INT) AS "order", s_suppkey, CAST(row_number() OVER (PARTITION BY "order" ORDER BY h, s_suppkey) - 1 AS BIGINT) AS position FROM x""")
def l10_permutations(spark, d):
    """Three orders of one stream by hash."""
    return S.permutations(table(spark, d, "supplier").select("s_suppkey"), "s_suppkey", 3, 3)


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Better' WHEN o_orderstatus = 'O' THEN 'Worse' ELSE 'Tie' END AS label, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN -1 ELSE 0 END AS utility,
CASE WHEN o_totalprice < 100000 THEN 3 WHEN o_totalprice >= 250000 THEN 0 WHEN length(o_orderpriority) / 8.0 < 0.25 OR length(o_orderpriority) / 8.0 > 1.5 THEN 2 ELSE 1 END AS rounds FROM orders""")
def f43_allocation(spark, d):
    """Utilities of labels, and a rule for rounds."""
    o = table(spark, d, "orders")
    lab = F.when(F.col("o_orderstatus") == "F", "Better").when(F.col("o_orderstatus") == "O", "Worse").otherwise("Tie")
    ratio = F.length("o_orderpriority") / 8.0
    n = F.when(F.col("o_totalprice") < 100000, 3).when(F.col("o_totalprice") >= 250000, 0).when((ratio < 0.25) | (ratio > 1.5), 2).otherwise(1)
    return o.select("o_orderkey", lab.alias("label"), rules.utility(lab).alias("utility"), n.alias("rounds"))


@query("""SELECT o_orderkey, CASE WHEN a = b THEN a ELSE 'Uncertain' END AS strict, CASE WHEN sa = 'uncertain' OR sb = 'uncertain' THEN 'uncertain' WHEN sa = sb THEN sa WHEN sa <> 'tie' AND sb <> 'tie' THEN 'uncertain' ELSE 'tie' END AS soft
FROM (SELECT o_orderkey, CASE v1 WHEN 'B' THEN 'Better' WHEN 'A' THEN 'Worse' WHEN 'TIE' THEN 'Tie' ELSE 'Uncertain' END AS a, CASE v2 WHEN 'A' THEN 'Better' WHEN 'B' THEN 'Worse' WHEN 'TIE' THEN 'Tie' ELSE 'Uncertain' END AS b,
CASE v1 WHEN 'B' THEN 'better' WHEN 'A' THEN 'worse' WHEN 'TIE' THEN 'tie' ELSE 'uncertain' END AS sa, CASE v2 WHEN 'A' THEN 'better' WHEN 'B' THEN 'worse' WHEN 'TIE' THEN 'tie' ELSE 'uncertain' END AS sb
FROM (SELECT o_orderkey, ['A', 'B', 'TIE', '?'][1 + o_orderkey % 4] AS v1, ['A', 'B', 'TIE', '?'][1 + o_custkey % 4] AS v2 FROM orders))""")
def j30_two_orders(spark, d):
    """Judgments in two orders, both ways to combine them."""
    names = F.array(*map(F.lit, ("A", "B", "TIE", "?")))
    o = table(spark, d, "orders").select("o_orderkey", F.get(names, F.col("o_orderkey") % 4).alias("v1"), F.get(names, F.col("o_custkey") % 4).alias("v2"))
    big = ("Better", "Worse", "Tie", "Uncertain")
    strict = rules.combine_strict(rules.winner(F.col("v1"), F.lit(False), big), rules.winner(F.col("v2"), F.lit(True), big))
    return o.select("o_orderkey", strict.alias("strict"), rules.combine_soft(rules.winner(F.col("v1"), F.lit(False)), rules.winner(F.col("v2"), F.lit(True))).alias("soft"))

"""Queries over selection policies, agreement, verdict assembly, memory and costs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmill.functions import rules
from quillmill.functions import text as T
from quillmill.operators import intervals as V
from quillmill.operators import isolation as I
from quillmill.operators import joins as J
from quillmill.operators import replay as G
from quillmill.operators import retrieval as R
from quillmill.operators import sampling as S
from quillmill.plans.registry import query
from quillmill.sources.readers import coalesced, first_rows, projected, table


def _lines(spark, d):
    return table(spark, d, "lineitem")


@query("""WITH c AS (SELECT o_custkey, o_orderkey, o_totalprice / 500000 AS better, (o_orderkey % 10) / 20.0 AS tie, (o_orderkey % 7) / 20.0 AS worse FROM orders),
k AS (SELECT * FROM c WHERE better > greatest(tie, worse) AND better - worse >= 0.02 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY better - worse DESC, better DESC, o_orderkey) = 1)
SELECT o.o_custkey, CAST(k.o_orderkey AS VARCHAR) AS chosen FROM (SELECT DISTINCT o_custkey FROM orders) o LEFT JOIN k USING (o_custkey)""")
def p29_best_by_margin(spark, d):
    """Of a customer's orders the one that leads by the margin."""
    one = F.struct(F.col("o_orderkey").alias("slot"), F.col("o_orderkey").cast("string").alias("text"), (F.col("o_totalprice") / 500000).alias("better"), (F.col("o_orderkey") % 10 / 20).alias("tie"), (F.col("o_orderkey") % 7 / 20).alias("worse"))
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(one).alias("c")).select("o_custkey", rules.best_by_margin(F.col("c"), 0.02).alias("chosen"))


@query("""SELECT o_custkey, arg_min(CAST(o_orderkey AS VARCHAR), o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS chosen, count(*) FILTER (WHERE o_orderpriority NOT LIKE '1%') AS n_failed, max(o_totalprice) > 400000 AS stops FROM orders GROUP BY 1""")
def p28_first_accepted(spark, d):
    """The first accepted candidate, the checks that failed, and whether to stop."""
    one = F.struct(F.col("o_orderkey").alias("slot"), F.col("o_orderkey").cast("string").alias("text"), F.when(F.col("o_orderstatus") == "F", "Accept").otherwise("Reject").alias("decision"))
    check = F.struct(F.col("o_orderkey").cast("string").alias("name"), F.when(F.col("o_orderpriority").startswith("1"), " yes").otherwise("no").alias("verdict"))
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(one)).alias("c"), F.collect_list(check).alias("k"), F.max("o_totalprice").alias("t"))
    return g.select("o_custkey", rules.first_accepted(F.col("c")).alias("chosen"), F.size(rules.failed_checks(F.col("k"))).cast("long").alias("n_failed"), rules.should_stop(F.col("t"), 400000).alias("stops"))


@query("""SELECT count(*) AS n, avg(CAST(a.l_returnflag = b.l_returnflag AS INT)) AS agree, count_if(a.l_returnflag IN ('A', 'R') AND b.l_returnflag IN ('A', 'R')) AS n_resolved,
avg(CASE WHEN a.l_returnflag IN ('A', 'R') AND b.l_returnflag IN ('A', 'R') THEN CAST(a.l_returnflag = b.l_returnflag AS INT) END) AS agree_resolved
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2""", ["agree", "agree_resolved"])
def j28_agreement(spark, d):
    """Agreement of two judges over all shared keys and over those that both resolve."""
    x = _lines(spark, d)
    return J.agreement(x.where("l_linenumber = 1"), x.where("l_linenumber = 2"), "l_orderkey", "l_returnflag", ["A", "R"])


@query("""WITH c AS (SELECT l_orderkey AS pair_id, l_linenumber = 2 AS rev, CASE WHEN l_quantity < 5 THEN CASE WHEN l_tax < 0.04 THEN 'TIE' ELSE ' b ' END ELSE CASE l_returnflag WHEN 'A' THEN ' a' WHEN 'R' THEN 'B' ELSE '?' END END AS v, l_discount >= 0.09 AS identical FROM lineitem WHERE l_linenumber <= 2),
w AS (SELECT pair_id, rev, identical, CASE WHEN upper(trim(v)) IN ('A', 'B') THEN CASE WHEN (upper(trim(v)) = 'A') = rev THEN 'better' ELSE 'worse' END WHEN upper(trim(v)) = 'TIE' THEN 'tie' ELSE 'uncertain' END AS v FROM c),
p AS (SELECT pair_id, coalesce(max(v) FILTER (WHERE NOT rev), 'uncertain') AS a, coalesce(max(v) FILTER (WHERE rev), 'uncertain') AS b, bool_or(identical) AS identical FROM w GROUP BY 1)
SELECT pair_id, CASE WHEN identical THEN 'tie' WHEN a = 'uncertain' OR b = 'uncertain' THEN 'uncertain' WHEN a = b THEN a WHEN a <> 'tie' AND b <> 'tie' THEN 'uncertain' ELSE 'tie' END AS verdict FROM p""")
def j15_two_calls(spark, d):
    """Verdicts of two calls in both orders, a repaired reply before the raw one, identical pairs tie."""
    repaired = F.when(F.col("l_quantity") < 5, F.when(F.col("l_tax") < 0.04, "TIE").otherwise(" b "))
    raw = F.when(F.col("l_returnflag") == "A", " a").when(F.col("l_returnflag") == "R", "B").otherwise("?")
    calls = _lines(spark, d).where("l_linenumber <= 2").select(F.col("l_orderkey").alias("pair_id"), (F.col("l_linenumber") == 2).alias("reverse"), raw.alias("raw"), repaired.alias("repaired"), (F.col("l_discount") >= 0.09).alias("identical"))
    return G.two_order_verdicts(calls)


@query("""WITH a AS (SELECT l_suppkey AS query, l_partkey AS doc, sum(l_quantity) AS raw FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2), b AS (SELECT l_suppkey AS query, l_partkey AS doc, sum(l_tax) AS raw FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2),
na AS (SELECT query, doc, CASE WHEN max(raw) OVER w - min(raw) OVER w <= 1e-12 THEN 1.0 ELSE (raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w) END AS norm FROM a WINDOW w AS (PARTITION BY query)),
nb AS (SELECT query, doc, CASE WHEN max(raw) OVER w - min(raw) OVER w <= 1e-12 THEN 1.0 ELSE (raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w) END AS norm FROM b WINDOW w AS (PARTITION BY query))
SELECT query, doc, coalesce(na.norm, 0) AS norm_a, coalesce(nb.norm, 0) AS norm_b, round(0.7 * coalesce(na.norm, 0) + 0.3 * coalesce(nb.norm, 0), 9) AS score FROM na FULL JOIN nb USING (query, doc)""", ["norm_a", "norm_b", "score"])
def r3_two_fields(spark, d):
    """Scores of two fields, each scaled within its query, combined to nine digits; a field without a score counts 0."""
    part = lambda flag, c: R.min_max(_lines(spark, d).where(F.col("l_returnflag") == flag).groupBy(F.col("l_suppkey").alias("query"), F.col("l_partkey").alias("doc")).agg(F.sum(c).alias("raw")))
    return R.combine(part("A", "l_quantity"), part("R", "l_tax"), 0.7)


@query("""WITH m AS (SELECT sha256(l_orderkey || chr(31) || 'memo') AS key, l_partkey AS doc FROM lineitem) SELECT key, count(*) AS n_docs FROM m WHERE key NOT IN (SELECT key FROM m WHERE doc NOT IN (SELECT p_partkey FROM part WHERE p_size <> 7)) GROUP BY key""")
def r9_valid_memos(spark, d):
    """Keys of remembered retrievals, those all of whose documents still exist."""
    memos = _lines(spark, d).groupBy(R.memo_key(F.col("l_orderkey"), F.lit("memo")).alias("key")).agg(F.collect_list("l_partkey").alias("docs"))
    return R.valid_memos(memos, table(spark, d, "part").where("p_size <> 7").select(F.col("p_partkey").alias("doc"))).select("key", F.size("docs").cast("long").alias("n_docs"))


@query("""WITH l AS (SELECT o_custkey AS sample_id, CAST(year(o_orderdate) AS BIGINT) AS y, o_orderkey, o_orderpriority AS before, CASE o_orderkey % 3 WHEN 0 THEN ' ' WHEN 1 THEN o_orderstatus ELSE o_orderpriority END AS candidate FROM orders),
s AS (SELECT *, dense_rank() OVER (PARTITION BY sample_id ORDER BY y) - 1 AS state_index FROM l), f AS (SELECT sample_id, y, arg_min(before, o_orderkey) AS before FROM l GROUP BY 1, 2)
SELECT s.sample_id, CAST(state_index AS INT) AS state_index, f.before, CAST(row_number() OVER (PARTITION BY s.sample_id, s.y ORDER BY o_orderkey) - 1 AS INT) AS slot, candidate, candidate = f.before AS identical, trim(candidate) <> '' AND candidate <> f.before AS valid FROM s JOIN f USING (sample_id, y)""")
def g13_candidates(spark, d):
    """States by candidates, with what makes a candidate valid."""
    text = F.when(F.col("o_orderkey") % 3 == 0, " ").when(F.col("o_orderkey") % 3 == 1, F.col("o_orderstatus")).otherwise(F.col("o_orderpriority"))
    one = F.struct("o_orderkey", F.col("o_orderpriority").alias("own"), text.alias("text"))
    states = table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.array_sort(F.collect_list(one)).alias("candidates")).select("o_custkey", F.struct("y", F.col("candidates")[0]["own"].alias("before"), "candidates").alias("s"))
    return G.flatten_candidates(states.groupBy(F.col("o_custkey").alias("sample_id")).agg(F.array_sort(F.collect_list("s")).alias("states")))


@query("""SELECT DISTINCT o_custkey AS key FROM orders WHERE o_totalprice > 150000 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def g10_admitted(spark, d):
    """Positive pairs that memory doesn't hold yet, one a key."""
    pairs = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), (F.col("o_totalprice") - 150000).alias("delta"))
    return G.admitted_memories(pairs, table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("key")), "key").select("key")


@query("""WITH g AS (SELECT o_custkey, CAST(sum(CAST(floor(o_totalprice) AS BIGINT) + o_orderkey) AS BIGINT) AS total_tokens, CAST(arg_min(CAST(floor(o_totalprice) AS BIGINT) + o_orderkey, o_orderkey) AS BIGINT) AS first_ FROM orders GROUP BY 1)
SELECT o_custkey, total_tokens, CASE WHEN o_custkey % 5 = 0 THEN 11 ELSE first_ END AS sequential_tokens FROM g""")
def a34_array_costs(spark, d):
    """Tokens of all generations and of those that had to follow each other, or an override."""
    one = F.struct("o_orderkey", F.floor("o_totalprice").alias("input_tokens"), F.col("o_orderkey").alias("output_tokens"))
    runs = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(one)).alias("generations"))
    runs = runs.withColumn("sequential", F.array(F.lit(0))).withColumn("override", F.when(F.col("o_custkey") % 5 == 0, F.lit(11).cast("long")))
    return G.array_costs(runs).select("o_custkey", "total_tokens", "sequential_tokens")


@query("""SELECT o_orderkey, o_totalprice AS q, o_orderpriority AS p FROM orders WHERE o_orderstatus <> 'F'""")
def j12_aligned(spark, d):
    """Two tables of one experiment side by side, an error where what they share differs."""
    o = table(spark, d, "orders")
    a, b = o.select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("q")), o.where("o_orderstatus <> 'F'").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("p"))
    return J.aligned(a, b, "o_orderkey", ["o_custkey"]).select("o_orderkey", "q", "p")


@query("""SELECT o_orderkey, '### Example ' || (o_orderkey % 9) || chr(10) || 'Source: ' || o_orderpriority || chr(10) || 'Draft: ' || o_orderstatus || chr(10) || 'Critique & Advice: ' || CASE o_custkey % 3 WHEN 0 THEN '(no advice given)' WHEN 1 THEN 'only ' || o_custkey ELSE 'last ' || o_custkey END || chr(10) || 'Refined (Gold): ' || o_orderpriority || '!' AS block FROM orders""")
def f27_example(spark, d):
    """Example units of a prompt."""
    n = F.col("o_custkey").cast("string")
    advice = F.when(F.col("o_custkey") % 3 == 0, " ").when(F.col("o_custkey") % 3 == 1, F.concat(F.lit("only "), n)).otherwise(F.concat(F.lit("first\n\nlast "), n, F.lit("\n\n ")))
    return table(spark, d, "orders").select("o_orderkey", T.example_block(F.col("o_orderkey") % 9, F.col("o_orderpriority"), F.col("o_orderstatus"), advice, F.concat("o_orderpriority", F.lit("!"))).alias("block"))


@query("""SELECT max(abs(l_discount - l_tax)) AS max_mismatch, count(*) AS n FROM lineitem""", ["max_mismatch"])
def g15_mismatch(spark, d):
    """The largest difference of two measurements."""
    return G.mismatch(_lines(spark, d), "l_discount", "l_tax")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)""")
def p22_quarantine(spark, d):
    """Rows of quarantined keys left out."""
    keys = table(spark, d, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("o_custkey"))
    return I.quarantine(table(spark, d, "orders").select("o_orderkey", "o_custkey"), keys, "o_custkey")


@query("""SELECT o_orderkey, CASE WHEN u >= 0.6 THEN 0 WHEN u < 0.6 * CAST(0.55 AS DOUBLE) THEN 3 WHEN r < 0.25 OR r > 2.5 THEN 2 ELSE 1 END AS rounds FROM (SELECT o_orderkey, (o_orderkey % 100) / 100.0 AS u, length(o_orderpriority) / 5.0 AS r FROM orders)""")
def w21_rounds(spark, d):
    """Rounds by first score and length."""
    return table(spark, d, "orders").select("o_orderkey", rules.rounds_allowed(F.col("o_orderkey") % 100 / 100, F.length("o_orderpriority") / 5.0, 0.6).alias("rounds"))


@query("""WITH p AS (SELECT o_orderpriority AS plan, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS retained, min(o_custkey) AS frontier FROM orders GROUP BY 1),
m AS (SELECT plan, total, retained, frontier, unnest(list_distinct(list_concat(range(64, 257, 50), list_concat(range(256, greatest(257, total + 1), 50), [256, total])))) AS stop FROM p),
n AS (SELECT *, greatest(least(256, total), least(total, frontier + greatest(0, CAST(ceil((2000 - retained) / 3.0) AS BIGINT)))) AS needed FROM m WHERE stop > 64 AND stop <= total)
SELECT plan, CASE WHEN frontier >= least(256, total) AND retained >= 2000 THEN frontier ELSE greatest(frontier, min(stop) FILTER (WHERE stop >= needed)) END AS horizon, count(DISTINCT stop) AS n_shards FROM n GROUP BY plan, frontier, total, retained""")
def x4_horizon(spark, d):
    """The shards of a plan, and up to which of them its sources are needed for certain."""
    p = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("plan")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("retained"), F.min("o_custkey").alias("frontier"))
    knobs = {"initial": 256, "size": 50, "pilot": 64}
    n = V.shards(p, "total", **knobs).groupBy("plan").agg(F.count(F.lit(1)).alias("n_shards"))
    return V.required_horizon(p, "frontier", "retained", "total", target=2000, most=3, **knobs).join(n, "plan").select("plan", "horizon", "n_shards")


@query("""SELECT event_id, event_type AS kind, coalesce(json_extract_string(props, '$.k'), 'none') AS k FROM events""")
def s9_coalesced(spark, d):
    """Nested fields under new names, the first alias that has a value."""
    e = table(spark, d, "events").select("event_id", F.struct("event_type", F.get_json_object("props", "$.k").alias("k")).alias("inner"))
    p = projected(e, {"event_id": "event_id", "kind": "inner.event_type", "k_raw": "inner.k"}).withColumn("k_default", F.lit("none"))
    return coalesced(p, {"k": ["k_missing", "k_raw", "k_default"]}).select("event_id", "kind", "k")


@query("""SELECT s_suppkey FROM (SELECT s_suppkey FROM supplier ORDER BY sha256('pilot' || chr(31) || s_suppkey), s_suppkey LIMIT 7)""")
def l7_hash_sample(spark, d):
    """The first seven in the order of a salted hash; the number is the operator's."""
    return S.hash_order(table(spark, d, "supplier").select("s_suppkey"), "pilot", "s_suppkey", 7)


@query("""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS slot, CASE WHEN o_orderkey % 11 = 0 THEN 'other' ELSE o_orderstatus || o_orderkey END AS hashed, o_orderstatus || o_orderkey AS request, o_orderpriority AS prompt, o_orderkey % 1000 AS seed FROM orders),
g AS (SELECT o_custkey, count(*) AS n, bool_or(hashed <> request) AS request, bool_or(slot > 2 OR slot % 2 <> CASE slot WHEN 1 THEN 1 ELSE 0 END OR o_orderkey % 13 = 0) AS temperature, count(DISTINCT seed) < count(*) AS seed, count(DISTINCT prompt) > 1 AS prompt FROM r GROUP BY 1)
SELECT o_custkey, concat_ws(',', CASE WHEN o_custkey % 7 = 0 THEN 'source' END, CASE WHEN n <> 3 THEN 'count' END, CASE WHEN request THEN 'request' END, CASE WHEN temperature THEN 'temperature' END, CASE WHEN seed THEN 'seed' END, CASE WHEN prompt THEN 'prompt' END) AS violations FROM g""")
def g8_record_audit(spark, d):
    """Collected records against their plan: sources, slots, hashes, temperatures, seeds, one prompt."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    slot = (F.row_number().over(w) - 1).cast("int")
    request = F.concat("o_orderstatus", F.col("o_orderkey").cast("string"))
    o = table(spark, d, "orders").withColumn("slot", slot).withColumn("request", request)
    one = F.struct("slot", "request", F.sha2(F.when(F.col("o_orderkey") % 11 == 0, "other").otherwise(F.col("request")), 256).alias("request_hash"), F.col("o_orderpriority").alias("prompt"), (F.col("o_orderkey") % 1000).alias("seed"), F.when(F.col("o_orderkey") % 13 == 0, 0.9).otherwise(F.when(F.col("slot") % 2 == 1, 0.7).otherwise(0.1)).alias("temperature"))
    records = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(one)).alias("candidates"))
    key = F.col("o_custkey").cast("string")
    records = records.withColumn("source", key).withColumn("source_hash", F.sha2(F.when(F.col("o_custkey") % 7 == 0, "else").otherwise(key), 256))
    return G.record_violations(records, [0.1, 0.7, 0.1]).select("o_custkey", F.array_join("violations", ",").alias("violations"))


@query("""SELECT o_orderkey, sha256(concat_ws(chr(31), CASE WHEN o_custkey % 4 <> 0 THEN 'depth=' || o_custkey % 4 END, 'mode=' || o_orderstatus, CASE WHEN o_orderpriority <> '1-URGENT' THEN 'renderer=' || o_orderpriority END)) AS config FROM orders""")
def f39_config_hash(spark, d):
    """a hash of settings that leaves out those at their default."""
    fields = {"renderer": F.col("o_orderpriority"), "mode": F.col("o_orderstatus"), "depth": F.col("o_custkey") % 4}
    return table(spark, d, "orders").select("o_orderkey", T.config_hash(fields, {"renderer": "1-URGENT", "depth": 0}).alias("config"))


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100""")
def l1_first_rows(spark, d):
    """The first hundred in the source's order; the number is the operator's."""
    return first_rows(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 100)


@query("""SELECT user_id, avg(TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'n/a' WHEN event_id % 3 = 1 THEN json_extract_string(props, '$.k') END AS DOUBLE)) AS mean FROM events GROUP BY 1""", ["mean"])
def a14_tolerant_mean(spark, d):
    """The mean of what reads as a number."""
    text = F.when(F.col("event_id") % 3 == 0, "n/a").when(F.col("event_id") % 3 == 1, F.get_json_object("props", "$.k"))
    return table(spark, d, "events").withColumn("x", text.try_cast("double")).groupBy("user_id").agg(F.avg("x").alias("mean"))

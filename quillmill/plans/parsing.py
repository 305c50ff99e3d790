"""Queries over parsers, tokens, keys and the rules and joins that read what they give."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.functions import metrics as M
from quillmill.functions import rules
from quillmill.functions import text as T
from quillmill.operators import joins as J
from quillmill.operators import pairs as P
from quillmill.operators import replay as G
from quillmill.operators import sampling as S
from quillmill.operators import stats as St
from quillmill.plans.registry import query
from quillmill.sources.readers import table


def _orders(spark, d):
    return table(spark, d, "orders")


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 > 0 THEN l_tax - 0.04 END AS delta, CASE l_returnflag WHEN 'A' THEN 'worse' WHEN 'R' THEN 'better' ELSE 'tie' END AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, coalesce(delta < 0, v = 'worse') AS negative, NOT coalesce(delta < 0, v = 'worse') AS admitted FROM x""")
def p7_negative(spark, d):
    """By the measured delta where there is one, else by the verdict."""
    delta = F.when(F.col("l_linenumber") % 3 > 0, F.col("l_tax") - 0.04)
    verdict = F.when(F.col("l_returnflag") == "A", "worse").when(F.col("l_returnflag") == "R", "better").otherwise("tie")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", rules.negative(delta, verdict).alias("negative"), rules.admitted(delta, verdict).alias("admitted"))


@query("""WITH x AS (SELECT o_orderkey, o_orderkey % 9 AS k, o_orderpriority AS b FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN 'context_length_exceeded' WHEN 1 THEN 'empty' WHEN 2 THEN 'unfinished' WHEN 3 THEN 'format' WHEN 4 THEN 'no_chinese' WHEN 5 THEN NULL WHEN 6 THEN CASE WHEN 22 > 1.5 * length(replace(b, ' ', '')) + 8 THEN 'length' END WHEN 7 THEN 'unfinished' ELSE NULL END AS reason FROM x""")
def p11_runtime(spark, d):
    """What is wrong with a text while it is generated, first things first."""
    k = F.col("o_orderkey") % 9
    text = F.when(k == 1, "  ").when(k == 3, "中 ```").when(k == 4, F.col("o_orderstatus")).when(k == 6, F.repeat(F.lit("中 "), 22)).otherwise("中文")
    finish = F.when(k == 0, "context_length_exceeded").when(k == 2, "length").when(k != 7, "stop")
    return _orders(spark, d).select("o_orderkey", rules.runtime_reason(F.when(k != 8, F.col("o_orderpriority")), text, finish).alias("reason"))


@query("""SELECT o_orderkey, o_orderstatus AS current, o_orderpriority AS candidate FROM orders""")
def p13_changed(spark, d):
    """Pairs, an error if one changes nothing."""
    return P.require_changed(_orders(spark, d).select("o_orderkey", F.col("o_orderstatus").alias("current"), F.col("o_orderpriority").alias("candidate")))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'Accept' ELSE 'Reject' END AS label, CASE WHEN o_totalprice > 100000 THEN 'Accept' ELSE 'Reject' END AS decision FROM orders""")
def j11_bijection(spark, d):
    """Predictions and labels one to one."""
    o = _orders(spark, d).select(F.col("o_orderkey").alias("id"), "o_orderstatus", "o_totalprice")
    accept = lambda c: F.when(c, "Accept").otherwise("Reject")
    return J.bijection(o.select("id", accept(F.col("o_totalprice") > 100000).alias("decision")), o.select("id", accept(F.col("o_orderstatus") == "F").alias("label")), "id")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderstatus || '/' || o_custkey END AS part FROM orders""")
def j17_id_part(spark, d):
    """The reference's id within a unit's id."""
    whole = F.concat_ws("/", F.lit("task"), F.lit("model"), "o_orderstatus", F.col("o_custkey").cast("string"), F.lit("0"))
    return _orders(spark, d).select("o_orderkey", T.id_part(F.when(F.col("o_orderkey") % 4 == 0, "task/model/0").otherwise(whole)).alias("part"))


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority <> '1-URGENT' AND count(*) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 0 THEN o_orderpriority ELSE '' END AS missing FROM orders""")
def j22_available(spark, d):
    """What a round retrieves must have been there from the start or come in before."""
    rounds = _orders(spark, d).select("o_custkey", "o_orderkey", F.array(F.lit("1-URGENT")).alias("initial"), F.array("o_orderpriority").alias("retrieved"), F.array("o_orderpriority").alias("admitted"))
    return J.available(rounds, "o_custkey", "o_orderkey").select("o_orderkey", F.array_join("missing", ",").alias("missing"))


@query("""SELECT l_orderkey, CAST(count(DISTINCT l_returnflag) AS INT) AS n_distinct, count(DISTINCT l_returnflag) = 1 AS all_identical FROM lineitem GROUP BY 1""")
def a34_distinct_per_round(spark, d):
    """Distinct candidates of a round, and rounds whose candidates are all the same."""
    return G.distinct_per_round(table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("candidates"))).select("l_orderkey", "n_distinct", "all_identical")


@query("""SELECT o_custkey, string_agg(o_orderstatus, ',' ORDER BY first_at) AS seen FROM (SELECT o_custkey, o_orderstatus, min(o_orderkey) AS first_at FROM orders GROUP BY 1, 2) GROUP BY 1""")
def u8_unique_in_order(spark, d):
    """U8: distinct values in the order in which they first come."""
    g = _orders(spark, d).groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("x"))
    return g.select("o_custkey", F.array_join(F.array_distinct(F.transform("x", lambda v: v["o_orderstatus"])), ",").alias("seen"))


@query("""WITH x AS (SELECT o_orderkey, CAST(o_orderkey % 12 AS INT) AS n FROM orders)
SELECT o_orderkey, CASE WHEN n = 0 THEN '' WHEN n <= 5 THEN array_to_string(range(0, n), ',') ELSE concat_ws(',', 0, CAST(round_even((n - 1) / 4, 0) AS INT), CAST(round_even((n - 1) / 2, 0) AS INT), CAST(round_even(3 * (n - 1) / 4, 0) AS INT), n - 1) END AS places FROM x""")
def w19_spread(spark, d):
    """Five places spread evenly over so many, halves to even."""
    return _orders(spark, d).select("o_orderkey", F.array_join(S.spread((F.col("o_orderkey") % 12).cast("int"), 5).cast("array<string>"), ",").alias("places"))


@query("""WITH c AS (SELECT n_nationkey, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1), u AS (SELECT n_nationkey, n, unnest(range(n)) AS unit FROM c),
taken AS (SELECT n_nationkey FROM u ORDER BY unit, n DESC, n_nationkey LIMIT 90)
SELECT n_nationkey, n, count(taken.n_nationkey) AS share FROM c LEFT JOIN taken USING (n_nationkey) GROUP BY 1, 2""")
def w21_allocate(spark, d):
    """A budget of 90 parted evenly over nations, none getting more than it has; the oracle deals unit by unit."""
    cells = table(spark, d, "nation").join(table(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_nationkey").agg(F.count("c_custkey").alias("n"))
    return S.allocate(cells, "n_nationkey", "n", 90).select("n_nationkey", "n", "share")


@query("""WITH t AS (SELECT o_orderpriority AS setting, CAST(count(DISTINCT o_orderstatus) AS DOUBLE) AS total, CASE WHEN o_orderpriority NOT LIKE '5%' THEN CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) / 10 END AS tau FROM orders GROUP BY 1)
SELECT setting, total, tau FROM t ORDER BY round(total, 6) DESC, coalesce(tau, -1) DESC LIMIT 1""")
def l12_best_setting(spark, d):
    """The setting of largest total, ties to the larger threshold."""
    digit = F.substring("o_orderpriority", 1, 1)
    t = _orders(spark, d).groupBy(F.col("o_orderpriority").alias("setting"), F.when(digit != "5", digit.cast("double") / 10).alias("tau")).agg(F.count_distinct("o_orderstatus").cast("double").alias("total"))
    return St.best_setting(t, "total", "tau").select("setting", "total", "tau")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN sha256('{"a":["' || o_orderstatus || '",null],"b":' || o_custkey || ',"é":{"x":true}}') END AS digest FROM orders""")
def f5_canonical(spark, d):
    """equal digests of JSON texts that differ in spaces and in the order of keys; none of broken ones."""
    key = F.col("o_custkey").cast("string")
    one = F.concat(F.lit('{"é": {"x":true},  "b": '), key, F.lit(', "a": ["'), "o_orderstatus", F.lit('", null]}'))
    other = F.concat(F.lit('{"a":["'), "o_orderstatus", F.lit('",null],"b":'), key, F.lit(',"\\u00e9":{"x":true}}'))
    k = F.col("o_orderkey") % 5
    return _orders(spark, d).select("o_orderkey", T.canonical_digest(F.when(k == 0, F.substring(one, 1, 9)).when(k < 3, one).otherwise(other)).alias("digest"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 0.0 WHEN o_orderkey % 4 = 1 THEN 1.0 ELSE CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.5 END END AS score FROM orders""", ["score"])
def f17_task_metric(spark, d):
    """Each task's own metric; an unknown task scores 0."""
    k = F.col("o_orderkey") % 4
    task = F.when(k == 0, "unknown").when(k == 1, "wmt19_zh_en").otherwise("gigaword")
    five = F.lit("a b c d e")
    ref, cand = F.when(k == 1, five).otherwise(F.concat(F.lit("x "), "o_orderstatus")), F.when(k == 1, five).otherwise("x F")
    return _orders(spark, d).select("o_orderkey", M.task_metric(task, ref, cand).alias("score"))


@query(r"""SELECT o_orderkey, array_to_string(CASE WHEN o_orderkey % 2 = 0 THEN regexp_extract_all(lower(o_orderpriority), '\w+|[^\w\s]') ELSE regexp_extract_all('中文' || replace(o_orderpriority, ' ', ''), '.') END, '|') AS tokens FROM orders""")
def f18_tokens(spark, d):
    """characters of texts with Han characters, words of others."""
    text = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise(F.concat(F.lit("中 文"), "o_orderpriority"))
    return _orders(spark, d).select("o_orderkey", F.array_join(T.language_aware_tokens(text), "|").alias("tokens"))


def _reply():
    """A controller's reply in five shapes."""
    k = F.col("o_orderkey") % 5
    stop = F.concat(F.lit('{"action": "stop", "reason": "'), "o_orderpriority", F.lit('"}'))
    go = F.concat(F.lit('{"action": "edit", "instruction": " '), "o_orderstatus", F.lit(' "}'))
    return F.when(k == 0, F.concat(F.lit("```json\n"), stop, F.lit("\n```"))).when(k == 1, F.concat(F.lit("Sure: "), go, F.lit(" done"))).when(k == 2, '{"action": "?"}').when(k == 3, "no object").otherwise('{"reason": "none"}')


@query("""WITH x AS (SELECT o_orderkey, o_orderkey % 5 AS k, '{"action": "stop", "reason": "' || o_orderpriority || '"}' AS s, '{"action": "edit", "instruction": " ' || o_orderstatus || ' "}' AS g FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN s WHEN 1 THEN g WHEN 2 THEN '{"action": "?"}' WHEN 4 THEN '{"reason": "none"}' END AS object FROM x""")
def f21_json_object(spark, d):
    """the JSON object in a reply, within a fence or among words."""
    return _orders(spark, d).select("o_orderkey", T.json_object(_reply()).alias("object"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 1 THEN 'REFINE' ELSE 'STOP' END AS action, CASE WHEN o_orderkey % 5 = 1 THEN o_orderstatus ELSE '' END AS instruction,
CASE o_orderkey % 5 WHEN 0 THEN o_orderpriority WHEN 3 THEN 'structured output failed after one repair retry' WHEN 4 THEN 'structured output failed after one repair retry' ELSE '' END AS reason, o_orderkey % 5 >= 3 AS failure FROM orders""")
def f24_controller(spark, d):
    """a controller's action, with what it falls back to."""
    return _orders(spark, d).select("o_orderkey", rules.controller_action(_reply()).alias("a")).select("o_orderkey", "a.*")


@query("""SELECT o_orderkey, 'k' || o_custkey AS id, CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'Tie' ELSE 'Uncertain' END AS winner, 'because' AS reason FROM orders WHERE o_orderkey % 3 < 2
UNION ALL SELECT o_orderkey, 'z', 'B', '' FROM orders WHERE o_orderkey % 3 = 0""")
def f22_verdicts(spark, d):
    """the verdicts in the first list of objects of a reply, one for each id."""
    k = F.col("o_orderkey") % 3
    word = F.when(F.col("o_orderstatus") == "F", " a").when(F.col("o_orderstatus") == "O", "TIE").otherwise("uncertain")
    one = F.concat(F.lit('{"id": "k'), F.col("o_custkey").cast("string"), F.lit('", "winner": "'), word, F.lit('", "reason": "because"}'))
    many = F.concat(F.lit("See [1] and [x: ["), one, F.lit(', {"id": "z", "winner": "B"}, {"id": "z", "winner": "A"}, {"id": "q", "winner": "?"}] {}'))
    return _orders(spark, d).select("o_orderkey", F.explode(T.verdicts(F.when(k == 0, many).when(k == 1, one).otherwise("[1, 2]"))).alias("v")).select("o_orderkey", "v.*")


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority WHEN 1 THEN o_orderstatus ELSE '' END AS paragraph FROM orders""")
def f25_last_paragraph(spark, d):
    """the last paragraph that isn't blank."""
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, F.concat(F.lit("first\n\n "), "o_orderpriority", F.lit(" \n\n  "))).when(k == 1, F.concat(F.lit(" "), "o_orderstatus"))
    return _orders(spark, d).select("o_orderkey", T.last_paragraph(text).alias("paragraph"))

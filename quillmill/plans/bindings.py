"""The driver's tables as the engine's entities, for Spark and, as common table expressions, for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.operators import pairs as P
from quillmill.sources.readers import table


def occurrences(spark: SparkSession, d: str) -> DataFrame:
    """Orders: a customer's priorities one after the other as (current, candidate), the price's change as delta."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias("source_id"),
        F.col("o_orderstatus").alias("generator"),
        F.col("o_orderpriority").alias("current"),
        F.lead("o_orderpriority").over(w).alias("candidate"),
        (F.lead("o_totalprice").over(w) - F.col("o_totalprice")).alias("delta"),
        "o_orderdate",
        "o_orderkey",
        (F.col("o_orderkey") % 4).cast("int").alias("temperature"),
    )
    too_long = F.when(F.length("candidate") > 1.5 * F.length("current") + 4, F.lit("length"))
    return P.occurrences(o.where("candidate is not null"), too_long)


def distinct_pairs(occ: DataFrame) -> DataFrame:
    return P.with_label(P.distinct_pairs(occ, ["o_orderdate", "o_orderkey"]))


OCC = """
o AS (SELECT CAST(o_custkey AS VARCHAR) AS source_id, o_orderstatus AS generator, o_orderpriority AS current,
  lead(o_orderpriority) OVER w AS candidate, lead(o_totalprice) OVER w - o_totalprice AS delta, o_orderdate, o_orderkey,
  CAST(o_orderkey % 4 AS INT) AS temperature
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
occ AS (SELECT *, sha256(source_id || chr(31) || current || chr(31) || candidate) AS pair_id, current = candidate AS noop,
  CASE WHEN length(candidate) > 1.5 * length(current) + 4 THEN 'length' ELSE 'valid' END AS reason,
  length(candidate) <= 1.5 * length(current) + 4 AS valid FROM o WHERE candidate IS NOT NULL),
pairs AS (SELECT *, CASE WHEN delta > 0 THEN 'Accept' ELSE 'Reject' END AS label FROM occ WHERE valid AND NOT noop
  QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY o_orderdate, o_orderkey) = 1)
"""


def rounds(spark: SparkSession, d: str) -> DataFrame:
    """Events: a user's events in time are the rounds of a sample."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(
        F.col("user_id").alias("sample_id"),
        (F.row_number().over(w) - 1).cast("int").alias("round_index"),
        F.when(F.col("event_type") == "error", "STOP").otherwise("REFINE").alias("action"),
        (F.col("event_type") == "purchase").alias("accepted"),
        "value",
        (F.col("value") - F.lag("value").over(w)).alias("delta"),
        F.get_json_object("props", "$.k").cast("long").alias("cost"),
        F.concat(F.lit("text "), F.repeat(F.lit("x"), F.pmod("event_id", F.lit(7)).cast("int"))).alias("candidate"),
        F.lit("draft").alias("initial_draft"),
        "event_type",
        "ts",
        "event_id",
    )


ROUNDS = """
r AS (SELECT user_id AS sample_id, CAST(row_number() OVER w - 1 AS INT) AS round_index,
  CASE WHEN event_type = 'error' THEN 'STOP' ELSE 'REFINE' END AS action, event_type = 'purchase' AS accepted, value,
  value - lag(value) OVER w AS delta, CAST(json_extract_string(props, '$.k') AS BIGINT) AS cost,
  'text ' || repeat('x', CAST(event_id % 7 AS INT)) AS candidate, 'draft' AS initial_draft, event_type, ts, event_id
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
"""


def traces(spark: SparkSession, d: str) -> DataFrame:
    """One row a sample with its rounds nested in order."""
    r = rounds(spark, d).withColumn("controller_action", F.col("action")).withColumn("judge_verdict", F.when(F.col("event_type").isin("purchase", "signup"), "better").otherwise("tie")).withColumn("judge_order_consistent", F.col("event_type") != "signup").withColumn("metric_offline", F.col("value")).withColumn("delta_offline", F.col("delta"))
    unit = F.struct("round_index", "controller_action", "candidate", "judge_verdict", "judge_order_consistent", "accepted", "metric_offline", "delta_offline", "cost")
    return r.groupBy("sample_id").agg(F.array_sort(F.collect_list(unit)).alias("rounds")).withColumn("initial_draft", F.lit("draft")).withColumn("initial_metric_offline", F.lit(1.0))


def arms(spark: SparkSession, d: str) -> DataFrame:
    """Line items: an arm's mean net price for each part is the metric of a sample."""
    net = F.round(F.avg(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 8)
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("arm"), F.col("l_partkey").alias("sample_id")).agg(net.alias("metric"))


ARMS = """
arms AS (SELECT l_returnflag AS arm, l_partkey AS sample_id, round(avg(l_extendedprice * (1 - l_discount)), 8) AS metric
  FROM lineitem GROUP BY 1, 2)
"""


def decisions(spark: SparkSession, d: str) -> DataFrame:
    """Line items as judged pairs of two models: truth, decision, a probability and the source cluster."""
    return table(spark, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"),
        F.col("l_linestatus").alias("model"),
        F.col("l_suppkey").alias("cluster"),
        F.when(F.col("l_returnflag") == "R", "Accept").otherwise("Reject").alias("label"),
        F.when(F.col("l_discount") > 0.05, "Accept").otherwise("Reject").alias("decision"),
        (F.col("l_tax") - 0.04).alias("delta"),
        F.round((F.col("l_quantity") + 0.5) / 52, 6).alias("p"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
    )


DECISIONS = """
dec AS (SELECT l_orderkey || '-' || l_linenumber AS id, l_linestatus AS model, l_suppkey AS cluster,
  CASE WHEN l_returnflag = 'R' THEN 'Accept' ELSE 'Reject' END AS label,
  CASE WHEN l_discount > 0.05 THEN 'Accept' ELSE 'Reject' END AS decision, l_tax - 0.04 AS delta,
  round((l_quantity + 0.5) / 52, 6) AS p, CAST(l_returnflag = 'R' AS INT) AS y FROM lineitem)
"""

#: Place of a draw among n, of replicate b and number i: what hash_draw gives.
DRAW = "CAST(('0x' || substr(md5('{seed}|' || b || '|' || i), 1, 15)) AS BIGINT) % n"

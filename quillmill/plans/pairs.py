"""Queries over pairs and occurrences."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.functions import rules
from quillmill.operators import isolation as I
from quillmill.operators import pairs as P
from quillmill.operators import sampling as S
from quillmill.plans.bindings import OCC, distinct_pairs, occurrences
from quillmill.plans.registry import query
from quillmill.sources.readers import table


@query(f"""WITH {OCC}, raw AS (SELECT count(*) AS raw_pairs, count_if(valid) AS valid_pairs, count_if(noop) AS no_op_pairs,
  count_if(valid AND NOT noop) AS valid_changed FROM occ),
u AS (SELECT count(*) AS unique_changed, count(DISTINCT source_id) AS source_clusters, count_if(label = 'Accept') AS accepts,
  count_if(label = 'Reject') AS rejects, count_if(label IS NULL) AS unscored FROM pairs)
SELECT raw.*, u.*, valid_changed - unique_changed AS duplicates, accepts / greatest(1, accepts + rejects) AS accept_ratio FROM raw, u""", ["accept_ratio"])
def a1_pair_summary(spark, d):
    """Counts of occurrences and of distinct labelled pairs."""
    occ = occurrences(spark, d)
    return P.summary(occ, distinct_pairs(occ))


@query(f"WITH {OCC} SELECT reason, count(*) AS n FROM occ WHERE NOT valid GROUP BY reason")
def a3_invalid_reasons(spark, d):
    return P.reasons(occurrences(spark, d))


@query(f"""WITH {OCC}, g AS (SELECT occ.generator, count(*) AS raw_pairs, count_if(occ.valid) AS valid_pairs, count_if(occ.noop) AS no_op_pairs,
  count(DISTINCT CASE WHEN occ.valid AND NOT occ.noop THEN occ.pair_id END) AS unique_changed,
  count(DISTINCT CASE WHEN p.label = 'Accept' THEN occ.pair_id END) AS accepts, count(DISTINCT CASE WHEN p.label = 'Reject' THEN occ.pair_id END) AS rejects
  FROM occ LEFT JOIN pairs p USING (pair_id) GROUP BY occ.generator)
SELECT *, accepts / greatest(1, accepts + rejects) AS accept_ratio FROM g""", ["accept_ratio"])
def a4_by_generator(spark, d):
    """A4, J6."""
    occ = occurrences(spark, d)
    return P.by_generator(occ, distinct_pairs(occ))


@query(f"""WITH {OCC}, x AS (SELECT DISTINCT occ.generator, p.pair_id, p.delta FROM pairs p JOIN occ USING (pair_id))
SELECT generator, quantile_cont(delta, 0.0) AS q00, quantile_cont(delta, 0.1) AS q10, quantile_cont(delta, 0.5) AS q50, quantile_cont(delta, 0.9) AS q90,
  quantile_cont(delta, 1.0) AS q100 FROM x GROUP BY generator""", ["q00", "q10", "q50", "q90", "q100"])
def a6_generator_quantiles(spark, d):
    """A6, J7."""
    occ = occurrences(spark, d)
    return P.generator_quantiles(occ, distinct_pairs(occ), [0.0, 0.1, 0.5, 0.9, 1.0])


@query(f"""WITH {OCC} SELECT occ.temperature, count(*) AS raw_occurrences, count_if(p.label = 'Accept') AS accepts, count_if(p.label = 'Reject') AS rejects
FROM occ LEFT JOIN pairs p USING (pair_id) GROUP BY occ.temperature""")
def j8_by_temperature(spark, d):
    """J8, A48."""
    occ = occurrences(spark, d)
    return P.by_bucket(occ, distinct_pairs(occ), "temperature")


@query(f"""WITH {OCC}, t AS (SELECT pair_id, string_agg(generator || ':' || o_orderkey, ',' ORDER BY o_orderdate, o_orderkey) AS provenance FROM occ GROUP BY pair_id)
SELECT pairs.pair_id, pairs.source_id, pairs.current, pairs.candidate, pairs.label, t.provenance FROM pairs JOIN t USING (pair_id)""")
def j9_export(spark, d):
    """Pairs with the provenance of all their occurrences."""
    occ = occurrences(spark, d)
    told = F.concat_ws(":", F.col("generator"), F.col("o_orderkey").cast("string"))
    out = P.export(occ, distinct_pairs(occ), told, ["o_orderdate", "o_orderkey"])
    return out.select("pair_id", "source_id", "current", "candidate", "label", F.array_join("provenance", ",").alias("provenance"))


@query(f"""WITH {OCC}, cache AS (SELECT DISTINCT current || '|' || candidate || '|' || source_id AS key, 0.5 AS score FROM occ WHERE temperature = 0)
SELECT DISTINCT current || '|' || candidate || '|' || source_id AS key FROM pairs WHERE current || '|' || candidate || '|' || source_id NOT IN (SELECT key FROM cache)""")
def j10_unscored(spark, d):
    """Pairs whose key a score cache lacks."""
    occ = occurrences(spark, d)
    key = F.concat_ws("|", "current", "candidate", "source_id").alias("key")
    cache = occ.where("temperature = 0").select(key).distinct().withColumn("score", F.lit(0.5))
    return P.unscored(distinct_pairs(occ).select(key), cache)


@query(f"""WITH {OCC}, cache AS (SELECT DISTINCT current || '|' || candidate || '|' || source_id AS key FROM occ WHERE temperature = 0)
SELECT pairs.pair_id, CASE WHEN cache.key IS NOT NULL THEN 0.5 END AS score FROM pairs LEFT JOIN cache ON cache.key = current || '|' || candidate || '|' || source_id""", ["score"])
def j10_scored(spark, d):
    """The cache's scores joined back."""
    occ = occurrences(spark, d)
    key = F.concat_ws("|", "current", "candidate", "source_id").alias("key")
    cache = occ.where("temperature = 0").select(key).distinct().withColumn("score", F.lit(0.5))
    return P.scored(distinct_pairs(occ).select("pair_id", key), cache).select("pair_id", "score")


@query(f"""WITH {OCC}, g AS (SELECT unnest([0.0, 1000.0, 25000.0, 100000.0]) AS epsilon)
SELECT CAST(epsilon AS DOUBLE) AS epsilon, count_if(delta > epsilon) AS accepts, count_if(delta < -epsilon) AS worse, count_if(abs(delta) <= epsilon) AS ties FROM pairs, g GROUP BY 1""")
def a28_epsilon_grid(spark, d):
    """A28, F30, J26."""
    grid = spark.createDataFrame([(0.0,), (1000.0,), (25000.0,), (100000.0,)], "epsilon double")
    return P.epsilon_grid(distinct_pairs(occurrences(spark, d)), grid)


@query(f"""WITH {OCC} SELECT CASE WHEN abs(delta) < 1000 THEN 'lt_1000' WHEN abs(delta) < 30000 THEN 'lt_30000' WHEN abs(delta) < 100000 THEN 'lt_100000' ELSE 'ge_100000' END AS bin,
CASE WHEN delta > 1e-8 THEN 'up' WHEN delta < -1e-8 THEN 'down' ELSE 'zero' END AS sign, count(*) AS n FROM pairs GROUP BY 1, 2""")
def a27_delta_histogram(spark, d):
    h = P.delta_histogram(distinct_pairs(occurrences(spark, d)), [1000, 30000, 100000])
    return h.withColumn("bin", F.regexp_replace("bin", "1e\\+05", "100000"))


@query(f"""WITH {OCC} SELECT source_id, pair_id, sha256('salt' || chr(31) || pair_id) AS h FROM pairs
QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY sha256('salt' || chr(31) || pair_id), pair_id) = 1""")
def w18_one_per_source(spark, d):
    """Of each source the pair of least salted hash."""
    from quillmill.functions.text import composite_key

    p = distinct_pairs(occurrences(spark, d)).select("source_id", "pair_id")
    return S.one_per_source(p, "salt", "source_id", "pair_id").withColumn("h", composite_key(F.lit("salt"), F.col("pair_id")))


@query(f"""WITH {OCC}, x AS (SELECT generator, pair_id, row_number() OVER (PARTITION BY generator ORDER BY sha256('rr' || chr(31) || pair_id), pair_id) AS turn FROM pairs)
SELECT generator, pair_id, turn FROM x ORDER BY turn, generator LIMIT 50""")
def w20_round_robin(spark, d):
    """A stratified sample of 50; the cap is the operator."""
    p = distinct_pairs(occurrences(spark, d)).select("generator", "pair_id")
    return S.round_robin(p, "generator", "rr", "pair_id", 50)


@query(f"""WITH {OCC} SELECT generator, pair_id FROM pairs WHERE label = 'Reject'
QUALIFY row_number() OVER (PARTITION BY generator ORDER BY sha256('cap' || chr(31) || pair_id), pair_id) <= 20""")
def w22_capped_rejects(spark, d):
    """20 rejected pairs of each generator, by hash; the cap is the operator."""
    p = distinct_pairs(occurrences(spark, d)).where("label = 'Reject'").select("generator", "pair_id")
    return S.per_group(p, "generator", "cap", "pair_id", 20)


@query(f"""WITH {OCC}, g AS (SELECT reason, valid, noop, generator, CASE WHEN noop THEN 'noop' WHEN NOT valid THEN 'invalid' WHEN generator = 'P' THEN 'pending' END AS why FROM occ)
SELECT coalesce(why, 'kept') AS reason, count(*) AS n FROM g GROUP BY 1""")
def p24_cascade(spark, d):
    """The first reason that holds, counted."""
    occ = occurrences(spark, d).drop("reason")
    c = I.cascade(occ, [("noop", F.col("noop")), ("invalid", ~F.col("valid")), ("pending", F.col("generator") == "P")])
    return c.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {OCC}, s AS (SELECT max(delta) - min(delta) AS spread, current || '>' || candidate AS key FROM occ GROUP BY 2)
SELECT key, spread FROM s WHERE spread > 1e-6""", ["spread"])
def p23_conflicting_keys(spark, d):
    """Keys whose deltas differ."""
    occ = occurrences(spark, d).withColumn("key", F.concat_ws(">", "current", "candidate"))
    return I.conflicting_keys(occ, "key", "delta")


@query(f"""WITH {OCC} SELECT pair_id, candidate AS current, current AS candidate, -delta AS delta, CASE WHEN -delta > 0 THEN 'Accept' ELSE 'Reject' END AS label FROM pairs""", ["delta"])
def f42_swapped(spark, d):
    """each pair the other way round."""
    return distinct_pairs(occurrences(spark, d)).select("pair_id", *rules.swapped("current", "candidate", "delta"))


@query(f"""WITH {OCC} SELECT pair_id, CASE WHEN delta < -25000 THEN 'worse' WHEN delta > 25000 THEN 'better' ELSE 'tie' END AS label3,
CASE WHEN delta > 1e-9 THEN 'helped' WHEN delta < -1e-9 THEN 'hurt' ELSE 'unchanged' END AS helped FROM pairs""")
def f31_label3(spark, d):
    """F30, F31."""
    p = distinct_pairs(occurrences(spark, d))
    return p.select("pair_id", rules.label3(F.col("delta"), 25000.0).alias("label3"), rules.helped(F.col("delta")).alias("helped"))


@query(f"""WITH {OCC}, c AS (SELECT generator AS from_split, temperature AS to_split FROM occ WHERE valid)
SELECT CAST(count(*) AS BIGINT) AS n, from_split, CAST(to_split AS VARCHAR) AS to_split FROM c GROUP BY 2, 3""")
def a29_crosstab(spark, d):
    """A29."""
    return occurrences(spark, d).where("valid").groupBy(F.col("generator").alias("from_split"), F.col("temperature").cast("string").alias("to_split")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {OCC}, k AS (SELECT current AS key FROM occ UNION ALL SELECT candidate FROM occ) SELECT key, count(*) AS n FROM k GROUP BY key""")
def a30_key_frequency(spark, d):
    """A30."""
    return I.key_frequency(occurrences(spark, d), ["current", "candidate"])


@query("""WITH n AS (SELECT CAST(o_orderkey // 500 AS BIGINT) AS shard, o_orderpriority AS generator, count(*) AS n FROM orders GROUP BY 1, 2),
s AS (SELECT shard, count_if(n >= 80) = 5 AS done FROM n GROUP BY shard)
SELECT shard, done FROM s WHERE shard < coalesce((SELECT min(shard) FROM s WHERE NOT done), 1000000000)""")
def x3_completed_prefix(spark, d):
    """Shards before the first that some generator hasn't finished."""
    from quillmill.operators import intervals as V

    o = table(spark, d, "orders").select(F.floor(F.col("o_orderkey") / 500).alias("shard"), F.col("o_orderpriority").alias("generator"))
    return V.completed_prefix(V.shard_progress(o, "shard", "generator", 5, 80), "shard", "done")


@query("""WITH c AS (SELECT n.n_name, m.seg FROM nation n, (SELECT DISTINCT c_mktsegment AS seg FROM customer) m),
k AS (SELECT n_name, c_mktsegment AS seg, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
SELECT c.n_name, c.seg, coalesce(k.n, 0) AS n, 12 AS expected, coalesce(k.n, 0) >= 12 AS complete FROM c LEFT JOIN k USING (n_name, seg)""")
def j25_completeness(spark, d):
    """A grid of settings with what is there."""
    from quillmill.operators import joins as J

    nations = table(spark, d, "nation").select("n_name", "n_nationkey")
    found = table(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", F.col("c_mktsegment").alias("seg"))
    return J.completeness(found, [nations.select("n_name"), found.select("seg").distinct()], ["n_name", "seg"], F.lit(12))

"""Registered queries do the whole job: each against a plain computation over all rows of the smallest tables."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from quillmill import plans
from quillmill.functions import metrics as M
from quillmill.operators import stats as St
from quillmill.operators.graph import pick
from quillmill.plans.bindings import decisions
from test_queries import SF, rows


def read(name, columns="*", order="ALL"):
    return duckdb.sql(f"SELECT {columns} FROM '{SF}/{name}.parquet' ORDER BY {order}").fetchall()


def cosines():
    ids, vectors = zip(*read("embeddings", "vec_id, embedding"))
    v = np.array(vectors, dtype=float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return {(a, b): c for i, a in enumerate(ids) if a % 20 == 0 for b, c in zip(ids, v[i] @ v.T) if a != b}


def test_dense_library_is_all_rows(spark):
    want = {k for k, c in cosines().items() if round(c, 6) >= 0.2}
    got = {(r["query"], r["doc"]) for r in plans.QUERIES["f35_dense"](spark, SF).collect()}
    assert got == want and any(b % 20 == 0 for _, b in got)


def test_hybrid_library_is_all_rows(spark):
    want = {(a, b) for (a, b), c in cosines().items() if (a + b) % 11 == 0 or round(c, 9) >= 0.2}
    got = {(r["query"], r["doc"]) for r in plans.QUERIES["r6_hybrid"](spark, SF).collect()}
    assert got == want and any(b % 20 == 0 for _, b in got)


def test_signatures_differ_by_a_late_sample(spark, tmp_path):
    items = [(arm, part, 100.0 + part + (arm == "N" and part == 90), 0.0) for arm in "ANR" for part in range(1, 100)] + [("A", 100, 5.0, 0.0)]
    spark.createDataFrame(items, "l_returnflag string, l_partkey long, l_extendedprice double, l_discount double").write.parquet(str(tmp_path / "lineitem.parquet"))
    s = {r.arm: r.signature for r in plans.QUERIES["a36_signature"](spark, str(tmp_path)).collect()}
    assert s["A"] == s["R"] != s["N"]


def test_round_robin_takes_all_orders(spark):
    assert any(r.winner > 3 for r in plans.QUERIES["w11_copeland"](spark, SF).collect())


def test_self_consistency_takes_all_turns(spark):
    turns = {}
    for conv, turn, text in read("conversations", "conv_id, turn, text", "conv_id, turn"):
        turns.setdefault(conv, []).append((turn, text))
    want = {conv: t[pick([x or "" for _, x in t])] for conv, t in turns.items()}
    got = {r.conv_id: (r.turn, r.text) for r in plans.QUERIES["r10_self_consistent"](spark, SF).collect()}
    assert got == want and any(turn > 3 for turn, _ in got.values())


def test_auc_of_resampled_clusters(spark):
    data = [("m", c, s, y) for c, s, y in (("a", 0.1, 0), ("a", 0.4, 0), ("b", 0.4, 1), ("b", 0.3, 0), ("c", 0.9, 1), ("c", 0.4, 1))]
    data += [("k", "a", 0.2, 1), ("k", "d", 0.2, 0), ("k", "d", 0.7, 1)]
    df = spark.createDataFrame(data, "model string, cluster string, p double, y int")
    draws = {}
    for r in St.replicates(spark.createDataFrame([(1, 4)], "g int, n long"), ["g"], 80, 3).collect():
        draws.setdefault(r.replicate, []).append("abcd"[r.place])
    want = {}
    for model in "mk":
        found = []
        for drawn in draws.values():
            mine = [(s, y) for c in drawn for m, c2, s, y in data if m == model and c2 == c]
            pos, neg = ([s for s, y in mine if y == k] for k in (1, 0))
            if pos and neg:
                found.append(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)))
        want[model] = (*np.quantile(found, [0.025, 0.975]).round(9), len(found))
    got = {r.model: (round(r.ci_low, 9), round(r.ci_high, 9), r.valid) for r in St.clustered_auc(df, "model", "cluster", "p", "y", 80, 3).collect()}
    assert got == want and all(0 < n < 80 for *_, n in got.values())


def test_model_differences_take_2000_resamples(spark):
    rows_ = decisions(spark, SF).select("model", "cluster", (F.col("decision") == F.col("label")).cast("long").alias("correct"))
    want = St.paired_model_differences(rows_, "model", "cluster", 2000, 5).toPandas()
    got = plans.QUERIES["t3_model_differences"](spark, SF).toPandas()
    assert rows(got.round(6)) == rows(want.round(6)) != rows(St.paired_model_differences(rows_, "model", "cluster", 60, 5).toPandas().round(6))


def test_interval_of_corpus_bleu_holds_the_point(spark):
    point = {r.part: r.bleu for r in plans.QUERIES["a42_corpus_bleu"](spark, SF).collect()}
    got = {r.part: (r.ci_low, r.ci_high) for r in plans.QUERIES["t9_corpus_bleu"](spark, SF).collect()}
    assert set(got) == set(point) and all(low <= point[k] <= high for k, (low, high) in got.items())


def test_chrf_by_hand(spark):
    rows = [("ab cd", "ab cd"), ("the cat.", "the dog."), ("", "x")]
    sums = spark.createDataFrame(rows, "ref string, cand string").select("ref", M.chrf_statistics(F.col("ref"), F.col("cand")).alias("s")).select("ref", "s.*")
    got = {r.ref: r for r in sums.withColumn("x", M.corpus_chrf({n: F.col(n) for n in M.CHRF_SUMS})).collect()}
    assert got["ab cd"].x == 100.0 and got[""].x == 0.0
    # of "thecat." and "thedog." four of seven letters agree, two of six pairs, one of five triples; of three words two, of two pairs none
    share = (4 / 7 + 2 / 6 + 1 / 5 + 0 + 0 + 0 + 2 / 3 + 0) / 8
    assert abs(got["the cat."].x - 100 * share) < 1e-9 and got["the cat."].ref6 == 3

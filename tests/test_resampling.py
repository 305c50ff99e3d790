"""Resampling makes no row for a draw, and its sums are those of the draws made one by one."""

import math
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from quillmill import plans
from quillmill.operators import resample as R
from quillmill.operators import stats as St
from test_queries import SF


def places(n, seed, b):
    return [int(md5(f"{seed}|{b}|{i}".encode()).hexdigest()[:15], 16) % n for i in range(n)]


def test_hashes_over_lengths_of_numbers():
    for some in (range(8, 10), range(10, 13), range(1999, 2000)):
        got = R.hashes(13, some, 95, 10_003)
        assert all(int(md5(f"13|{b}|{i}".encode()).hexdigest()[:15], 16) == got[r, i - 95] for r, b in enumerate(some) for i in range(95, 10_004))


@pytest.mark.parametrize("values", [R.VALUES, 50_000])
def test_sums_of_groups_of_several_pieces(spark, monkeypatch, values):
    """Of 70,000 places and of 9, some missing, null, infinite or beyond 2^53 in sum; few and many values a task."""
    monkeypatch.setattr(R, "VALUES", values)
    rows = spark.range(70_000).select(F.lit("big").alias("g"), F.col("id").alias("place"), F.lit(70_000).alias("n"), (F.col("id") % 300 - 20).alias("a"), F.when(F.col("id") % 7 > 0, F.col("id") / 8).alias("x"))
    few = spark.createDataFrame([("few", p, 9, 2**52 + p, math.inf if p == 4 else None) for p in (0, 3, 4)], "g string, place long, n int, a long, x double")
    one = spark.createDataFrame([(None, 69_000, 70_000, 5, 1.0)], "g string, place long, n int, a long, x double")
    want = {}
    for g, n, table in (("big", 70_000, {p: (p % 300 - 20, p / 8 if p % 7 else None) for p in range(70_000)}), ("few", 9, {p: (2**52 + p, math.inf if p == 4 else None) for p in (0, 3, 4)}), (None, 70_000, {69_000: (5, 1.0)})):
        for b in range(12):
            drawn = [table[p] for p in places(n, 3, b) if p in table]
            if drawn:
                xs = [x for _, x in drawn if x is not None]
                want[g, b] = (sum(a for a, _ in drawn), sum(xs) if xs else None)
    got = {(r.g, r.replicate): (r.a, r.x) for r in R.drawn_sums(rows.union(few).union(one), ["g"], ["a", "x"], 12, 3).collect()}
    assert got == want and any(x is None for _, x in want.values()) and any(x == math.inf for _, x in want.values()) and 0 < len([1 for g, _ in want if g is None]) < 12


def draws_of(df):
    """Whether the plan makes draws as rows."""
    return "md5(" in df._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("name", ["t9_corpus_bleu", "t14_clustered_auc", "t1_paired_bootstrap", "t2_clustered_bootstrap", "t3_model_differences", "t5_clustered_f1"])
def test_no_row_for_a_draw(spark, name):
    assert not draws_of(plans.QUERIES[name](spark, SF))


def test_shared_draws_of_unequal_groups(spark):
    """All groups see the draws of the largest; a replicate that draws none of a group's places has no row."""
    rows = spark.createDataFrame([("m", c, 1) for c in range(12)] + [("k", c, 10) for c in (5, 8)], "g string, c long, v long")
    got = {(r.g, r.replicate): r.v for r in St.resampled_sums(rows, ["g"], ["v"], "c", 40, 1, shared=[]).collect()}
    want = {("m", b): 12 for b in range(40)} | {("k", b): 10 * k for b in range(40) if (k := sum(p < 2 for p in places(12, 1, b)))}
    assert got == want and len(want) < 80

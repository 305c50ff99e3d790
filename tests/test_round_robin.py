"""The round robin of a customer's orders where prices are equal or missing, against its SQL on one thread."""

import duckdb

from quillmill import plans

ORDERS = [(1, 10, 5.0), (2, 10, 9.0), (3, 10, 9.0), (4, 10, 9.0), (5, 11, 7.0), (6, 11, None), (7, 12, None), (8, 12, None), (9, 13, 1.0), (10, None, 2.0), (11, None, 2.0)]


def test_equal_and_missing_prices(spark, tmp_path):
    spark.createDataFrame(ORDERS, "o_orderkey long, o_custkey long, o_totalprice double").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    got = {(r.group, r.winner) for r in plans.QUERIES["w11_copeland"](spark, str(tmp_path)).collect()}
    assert got == set(con.execute(plans.SQL["w11_copeland"]).fetchall()) == {(10, 1), (11, 0), (12, None), (None, 0)}

"""Named queries: a function (spark, sf_dir) -> DataFrame, and SQL that says the same to another engine."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _counts(sql: str) -> str:
    """count_if(x) as a count of BIGINT, the type that Spark gives it."""
    while (at := sql.find("count_if(")) >= 0:
        depth, end = 1, at + 9
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(CASE WHEN {sql[at + 9 : end - 1]} THEN 1 END){sql[end:]}"
    return sql


def query(sql: str | None = None, digits: Sequence[str] = ()):
    """Register a function under its name. digits: double columns that both sides round to six digits (sums in another order)."""

    def keep(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(spark, sf_dir).withColumns({c: F.round(c, 6) for c in digits})

        QUERIES[fn.__name__] = run
        if sql:
            text = _counts(sql.strip())
            SQL[fn.__name__] = f"SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in digits)}) FROM ({text})" if digits else text
        return fn

    return keep

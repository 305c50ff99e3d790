"""Field-wise BM25, dense similarity, fusion, per-class quotas: all by equi-joins on tokens and windows by query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions import rules
from quillmill.functions.text import field_tokens

#: Digits that a ranking key keeps: sums in another order must not flip ranks.
DIGITS = 9


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, token, tf, length."""
    return docs.select(F.col(id_col).alias("doc"), field_tokens(F.col(text_col)).alias("t")).select("doc", F.size("t").alias("length"), F.explode("t").alias("token")).groupBy("doc", "length", "token").agg(F.count(F.lit(1)).alias("tf"))


def index(docs: DataFrame, id_col: str, text_col: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """doc, token, weight: what a query token that the document holds adds to its BM25 score."""
    posts = postings(docs, id_col, text_col)
    total = posts.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total"))
    stats = docs.agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total)).select("n", F.try_divide("total", "n").alias("mean"))
    df = posts.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return posts.join(df, "token").crossJoin(F.broadcast(stats)).select("doc", "token", (rules.idf(F.col("n"), F.col("df")) * rules.saturation(F.col("tf"), F.col("length"), F.col("mean"), k1, b)).alias("weight"))


def bm25(queries: DataFrame, indexed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """query, doc, raw: over the query's distinct tokens, for documents that share one."""
    q = queries.select(F.col(id_col).alias("query"), F.explode(F.array_distinct(field_tokens(F.col(text_col)))).alias("token"))
    return q.join(indexed, "token").groupBy("query", "doc").agg(F.sum("weight").alias("raw"))


def min_max(scores: DataFrame) -> DataFrame:
    """query, doc, norm: raw scaled to 0..1 within its query; 1 for all where they are equal."""
    w = Window.partitionBy("query")
    low, high = F.min("raw").over(w), F.max("raw").over(w)
    return scores.select("query", "doc", F.when(high - low <= 1e-12, 1.0).otherwise((F.col("raw") - low) / (high - low)).alias("norm"))


def combine(first: DataFrame, second: DataFrame, alpha: float) -> DataFrame:
    """query, doc, norm_a, norm_b, score of two fields; a field without a score counts 0."""
    full = first.withColumnRenamed("norm", "norm_a").join(second.withColumnRenamed("norm", "norm_b"), ["query", "doc"], "full").fillna(0.0, ["norm_a", "norm_b"])
    return full.withColumn("score", F.round(alpha * F.col("norm_a") + (1 - alpha) * F.col("norm_b"), DIGITS))


def ranked(scores: DataFrame, ascending_ids: bool = False) -> DataFrame:
    """Adds rank: score downwards, ids downwards too (or upwards, for the components of a fusion)."""
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc").asc() if ascending_ids else F.col("doc").desc())
    return scores.withColumn("rank", F.row_number().over(w))


def top_k(scores: DataFrame, k: int) -> DataFrame:
    return ranked(scores).where(F.col("rank") <= k)


def quota_top_k(scores: DataFrame, k: int) -> DataFrame:
    """k per query, at most half (rounded up) of a class at first, then filled up in order of rank: adds place."""
    cap = (k + 1) // 2
    r = ranked(scores)
    r = r.withColumn("in_class", F.row_number().over(Window.partitionBy("query", "class").orderBy("rank")))
    place = F.row_number().over(Window.partitionBy("query").orderBy((F.col("in_class") > cap).cast("int"), "rank"))
    return r.withColumn("place", place).where(F.col("place") <= k)


def profile_top_k(scores: DataFrame, profile: dict[str, int]) -> DataFrame:
    """Exactly as many of each class as the profile says, in order of rank; fewer where a class has fewer."""
    r = ranked(scores)
    r = r.withColumn("in_class", F.row_number().over(Window.partitionBy("query", "class").orderBy("rank")))
    want = F.lit(0)
    for name, n in profile.items():
        want = F.when(F.col("class") == name, n).otherwise(want)
    return r.where(F.col("in_class") <= want)


def random_in_profile(scores: DataFrame, counts: DataFrame, salt: str) -> DataFrame:
    """As many of each class as counts(query, class, n) says, in an order by hash, among the same candidates."""
    from quillmill.functions.text import hash_rank

    w = Window.partitionBy("query", "class").orderBy(hash_rank(F.lit(salt), F.col("query"), F.col("doc")), "doc")
    return scores.withColumn("draw", F.row_number().over(w)).join(counts, ["query", "class"]).where("draw <= n").drop("n")


def drop_own(scores: DataFrame, own: DataFrame) -> DataFrame:
    """Without pairs of own(query, doc), which have the same source text; after the scaling, which they took part in."""
    return scores.join(own, ["query", "doc"], "left_anti")


#: Bytes of query vectors up to which their blocks are broadcast, and rows of a block.
SHIPPED_BYTES, BLOCK_ROWS = 64 << 20, 1024


def _blocks(rows: DataFrame, id_col: str, vector: str, n: int, names: tuple[str, str, str]) -> DataFrame:
    """block, ids, vectors: the rows dealt over n blocks by the hash of their id."""
    block, ids, vectors = names
    both = F.collect_list(F.struct(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v")))
    return rows.groupBy(F.pmod(F.xxhash64(id_col), F.lit(n)).alias(block)).agg(both.alias("x")).select(block, F.col("x.id").alias(ids), F.col("x.v").alias(vectors))


def _cosines_of_blocks(least: float | None):
    """query, doc, cos of rows (ids, vectors, qids, qvectors): one matrix product a row."""

    def unit(vectors: list) -> np.ndarray:
        m = np.array(vectors, np.float64)
        size = np.sqrt((m * m).sum(1, keepdims=True))
        return np.divide(m, size, out=np.zeros_like(m), where=size > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of_doc, of_query = batch.schema.field("ids").type.value_type, batch.schema.field("qids").type.value_type
            for ids, vectors, qids, qvectors in zip(*(c.to_pylist() for c in batch.columns)):
                cos = unit(qvectors) @ unit(vectors).T
                q, d = np.nonzero(cos >= least) if least is not None else (x.ravel() for x in np.indices(cos.shape))
                for k in range(0, len(q), 1 << 16):
                    part = slice(k, k + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(qids, of_query).take(pa.array(q[part])), pa.array(ids, of_doc).take(pa.array(d[part])), pa.array(cos[q[part], d[part]])], names=["query", "doc", "cos"])

    return run


def dense(queries: DataFrame, library: DataFrame, vector: str, least: float | None = None) -> DataFrame:
    """query, doc, cos of queries(query, vector) against a library(doc, vector), all or those of ``least`` and more.

    The queries are a stated set. They and the library are cut into blocks of some 1,024 rows; each block of the library
    meets each block of queries, and a meeting is one matrix product. The query blocks are broadcast while their vectors take
    at most 64 MB and are joined by their number beyond that. A vector of norm 0 has cosine 0 with all.
    """
    n, width = queries.agg(F.count(F.lit(1)), F.max(F.size(vector))).first()
    rows = library.count()
    kinds = queries.schema["query"].dataType.simpleString(), library.schema["doc"].dataType.simpleString()
    n_blocks, n_parts = max(1, -(-n // BLOCK_ROWS)), max(1, -(-rows // BLOCK_ROWS))
    q = _blocks(queries, "query", vector, n_blocks, ("block", "qids", "qvectors"))
    parts = _blocks(library, "doc", vector, n_parts, ("part", "ids", "vectors")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    met = parts.join(F.broadcast(q) if n * 8 * (width or 0) <= SHIPPED_BYTES else q, "block").select("ids", "vectors", "qids", "qvectors")
    return met.mapInArrow(_cosines_of_blocks(least), f"query {kinds[0]}, doc {kinds[1]}, cos double")


def hybrid(lexical: DataFrame, dense_: DataFrame, weight: float, floor: float = 0.2, k: int = 60) -> DataFrame:
    """query, doc, cos, score: reciprocal ranks of both kinds, over what is lexically scored or similar enough; else none."""
    both = lexical.select("query", "doc", "score").join(dense_, ["query", "doc"], "full").fillna(0.0, ["score", "cos"])
    both = both.withColumn("cos9", F.round("cos", DIGITS)).where((F.col("score") > 0) | (F.col("cos9") >= floor))
    by = lambda c: F.row_number().over(Window.partitionBy("query").orderBy(F.col(c).desc(), F.col("doc").asc()))
    r = both.withColumn("r1", by("score")).withColumn("r2", by("cos9"))
    return r.select("query", "doc", "cos", F.round(rules.rank_fusion(F.col("r1"), F.col("r2"), weight, k), 12).alias("score"))


def per_query(rows: DataFrame, order: str = "place") -> DataFrame:
    """One row a query: ids and scores in order, counts by class."""
    got = rows.groupBy("query").agg(F.array_sort(F.collect_list(F.struct(order, "doc", "score", "class"))).alias("x"))
    count = F.aggregate(F.array_distinct(F.transform("x", lambda e: e["class"])), F.create_map().cast("map<string,int>"), lambda m, c: F.map_concat(m, F.create_map(c, F.size(F.filter("x", lambda e: e["class"] == c)))))
    return got.select("query", F.transform("x", lambda e: e["doc"]).alias("docs"), F.transform("x", lambda e: e["score"]).alias("scores"), count.alias("class_counts"))


def memo_key(*parts: Column) -> Column:
    from quillmill.functions.text import composite_key

    return composite_key(*parts)


def fingerprint(library: DataFrame, id_col: str) -> DataFrame:
    """One row: a hash of the library's ids that doesn't depend on their order: the sum of 60-bit ranks, and their number."""
    from quillmill.functions.text import hash_rank

    return library.agg(F.sum(hash_rank(F.col(id_col)).cast("decimal(38,0)")).alias("fingerprint"), F.count(F.lit(1)).alias("n"))


def valid_memos(memos: DataFrame, known: DataFrame) -> DataFrame:
    """Memos(key, docs) all of whose ids still exist in known(doc)."""
    gone = memos.select("key", F.explode("docs").alias("doc")).join(known.select("doc"), "doc", "left_anti").select("key").distinct()
    return memos.join(gone, "key", "left_anti")

"""Queries over documents, benchmark, labels, embeddings and conversations: isolation, retrieval, text functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmill.functions import metrics as M
from quillmill.functions import rules
from quillmill.functions import text as T
from quillmill.operators import isolation as I
from quillmill.operators import joins as J
from quillmill.operators import pairs as P
from quillmill.operators import retrieval as R
from quillmill.operators import sampling as S
from quillmill.plans.bindings import DRAW
from quillmill.plans.registry import query
from quillmill.sources.readers import table

#: NFKC changes none of the driver's texts, so the oracle folds case and drops white space.
NORM = "regexp_replace(replace(lower(text), 'ß', 'ss'), '\\s', '', 'g')"


def _docs(spark, d):
    return table(spark, d, "documents")


@query(f"SELECT doc_id, sha256({NORM}) AS key, sha256(text) AS raw_key FROM documents")
def f1_text_keys(spark, d):
    """normalised and raw keys."""
    return _docs(spark, d).select("doc_id", T.text_key(F.col("text")).alias("key"), F.sha2("text", 256).alias("raw_key"))


@query("SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(replace(lower(text), 'ß', 'ss'), '\\s+'), lambda w: w <> ''), ' ') AS key FROM documents")
def f3_simple_key(spark, d):
    return _docs(spark, d).select("doc_id", T.simple_key(F.col("text")).alias("key"))


@query("""WITH k AS (SELECT doc_id, CAST(('0x' || substr(sha256('7' || chr(31) || CAST(doc_id AS VARCHAR)), 1, 15)) AS BIGINT) AS rank FROM documents)
SELECT doc_id, rank, rank % 2147483648 AS seed FROM k""")
def f7_hash_rank(spark, d):
    """ranks and seeds from ids."""
    return _docs(spark, d).select("doc_id", T.hash_rank(F.lit(7), F.col("doc_id")).alias("rank"), T.seed31(F.lit(7), F.col("doc_id")).alias("seed"))


@query("SELECT doc_id, CAST(count(*) AS INT) AS n_tokens, count(DISTINCT t) AS n_distinct FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM documents) GROUP BY doc_id")
def f8_field_tokens(spark, d):
    """F8."""
    t = _docs(spark, d).select("doc_id", T.field_tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query("SELECT doc_id, CAST(floor(len(regexp_extract_all(text, '[A-Za-z0-9]+')) * CAST(1.3 AS DOUBLE)) + 8 AS INT) AS approx FROM documents")
def f26_approx_tokens(spark, d):
    """F26 (no CJK in these texts; a test has some)."""
    return _docs(spark, d).select("doc_id", T.approx_tokens(F.col("text")).alias("approx"))


@query("SELECT doc_id, trim(CASE WHEN position(':' IN text) > 0 THEN substr(text, position(':' IN text) + 1) ELSE text END) AS rest FROM documents")
def f28_strip_prefix(spark, d):
    return _docs(spark, d).select("doc_id", T.strip_prefix(F.col("text")).alias("rest"))


@query("""WITH k AS (SELECT text, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY text)
SELECT first_id, n FROM k WHERE n > 1""")
def u7_merge_records(spark, d):
    """Records merged by digest, the first id kept, their number."""
    docs = _docs(spark, d).select(F.sha2("text", 256).alias("digest"), "doc_id", F.col("source").alias("where"))
    return I.merge_records(docs.withColumn("first_id", F.col("doc_id")), "digest", "doc_id", "where").where("n_records > 1").select("first_id", F.col("n_records").alias("n"))


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def w16_keep_first(spark, d):
    return P.keep_first(_docs(spark, d), ["text"], [F.col("doc_id")]).select("doc_id", "source")


@query(f"""WITH k AS (SELECT doc_id, source, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, sha256({NORM}) AS key FROM documents)
SELECT key, count(DISTINCT split) AS n_splits, count(*) AS n_rows FROM k GROUP BY key HAVING count(DISTINCT split) > 1""")
def j24_split_leaks(spark, d):
    """Keys that stand in more than one split, without a self-join."""
    docs = _docs(spark, d).withColumn("split", F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train")).withColumn("key", T.text_key(F.col("text")))
    return I.split_leaks(docs, "key", "split")


@query("""WITH a AS (SELECT * FROM documents WHERE doc_id % 5 <> 0), b AS (SELECT text FROM documents WHERE doc_id % 5 = 0)
SELECT doc_id, lang FROM a WHERE text NOT IN (SELECT text FROM b)""")
def j18_exclude(spark, d):
    """Training rows whose text no test row has."""
    docs = _docs(spark, d).withColumn("key", F.sha2("text", 256))
    return I.exclude(docs.where("doc_id % 5 <> 0"), docs.where("doc_id % 5 = 0"), "key").select("doc_id", "lang")


@query(f"""WITH f AS (SELECT sha256(text) AS key FROM documents WHERE doc_id % 7 = 0 UNION SELECT sha256({NORM}) FROM documents WHERE doc_id % 7 = 0 UNION SELECT sha256(text) FROM benchmark)
SELECT doc_id FROM documents WHERE doc_id % 7 <> 0 AND sha256(text) NOT IN (SELECT key FROM f) AND sha256({NORM}) NOT IN (SELECT key FROM f)""")
def j19_exclude_either(spark, d):
    """Rows that share neither the raw nor the normalised key with a blocklist of several sources."""
    docs = _docs(spark, d).withColumn("raw", F.sha2("text", 256)).withColumn("normed", T.text_key(F.col("text")))
    block = docs.where("doc_id % 7 = 0")
    listed = I.blocklist(block.select(F.col("raw").alias("key")), block.select(F.col("normed").alias("key")), table(spark, d, "benchmark").select(F.sha2("text", 256).alias("key")))
    return I.exclude_either(docs.where("doc_id % 7 <> 0"), "doc_id", ["raw", "normed"], listed).select("doc_id")


@query("""WITH a AS (SELECT text, source FROM documents WHERE doc_id % 3 = 0), b AS (SELECT DISTINCT text, source AS to_split FROM documents WHERE doc_id % 3 <> 0)
SELECT a.source AS from_split, b.to_split, count(*) AS n FROM a JOIN b USING (text) GROUP BY 1, 2""")
def j20_overlap_crosstab(spark, d):
    """Where rows of a small set come again in the rest."""
    docs = _docs(spark, d).withColumn("key", F.sha2("text", 256))
    return I.split_crosstab(docs.where("doc_id % 3 = 0"), docs.where("doc_id % 3 <> 0"), "key", "source")


@query(r"SELECT doc_id, item_id FROM documents d JOIN benchmark b ON len(regexp_split_to_array(trim(b.text), '\s+')) >= 4 AND contains(d.text, b.text)")
def j20_containment(spark, d):
    """Benchmark items that stand in a document word for word, by an equi-join on the items' beginnings."""
    return I.containment(_docs(spark, d), table(spark, d, "benchmark"))


@query("""SELECT (SELECT count(*) FROM (SELECT DISTINCT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)) AS both,
(SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS only_a, (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) AS only_b""")
def u3_set_sizes(spark, d):
    """U3, U9, J3."""
    return I.set_sizes(_docs(spark, d), table(spark, d, "labels"), "doc_id")


@query("SELECT lang FROM documents GROUP BY lang HAVING count(DISTINCT source) = (SELECT count(DISTINCT source) FROM documents)")
def u2_in_every_source(spark, d):
    """U2."""
    return I.in_every_group(_docs(spark, d), "lang", "source")


@query("""SELECT doc_id, CASE WHEN contains(text, chr(65533)) THEN 'damaged' WHEN length(text) < 40 THEN 'short' WHEN contains(text, 'All rights reserved') OR contains(text, 'License') THEN 'licence' END AS reason FROM documents
WHERE contains(text, chr(65533)) OR length(text) < 40 OR contains(text, 'All rights reserved') OR contains(text, 'License')""")
def p25_cascade(spark, d):
    """Damaged, short and licensed texts, each with its first reason."""
    t = F.col("text")
    c = I.cascade(_docs(spark, d), [("damaged", t.contains("�")), ("short", F.length(t) < 40), ("licence", t.contains("All rights reserved") | t.contains("License"))])
    return c.where("reason is not null").select("doc_id", "reason")


@query("SELECT doc_id, text, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def j1_with_default(spark, d):
    """J1, J14, J28."""
    return J.with_default(_docs(spark, d).select("doc_id", "text"), table(spark, d, "labels"), "doc_id", "quality", -1)


@query("SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 0 AND l.quality = 1")
def p5_positive(spark, d):
    """Rows of the positive class."""
    return _docs(spark, d).join(table(spark, d, "labels").where("toxic = 0 and quality = 1"), "doc_id").select("doc_id", "lang", "quality")


@query("""WITH q AS (SELECT quality AS x, toxic AS y FROM labels) SELECT count(*) AS n, avg(CAST(x = y AS DOUBLE)) AS agree,
count_if(x IN (0, 1) AND y IN (1)) AS n_resolved, avg(CASE WHEN y IN (1) THEN CAST(x = y AS DOUBLE) END) AS agree_resolved FROM q""", ["agree", "agree_resolved"])
def j28_agreement(spark, d):
    """How often two label columns agree, over all and over resolved rows."""
    lab = table(spark, d, "labels")
    a, b = lab.select("doc_id", F.col("quality").alias("v")), lab.select("doc_id", F.col("toxic").alias("v"))
    j = a.join(b.withColumnRenamed("v", "w"), "doc_id")
    eq = (F.col("v") == F.col("w")).cast("double")
    return j.agg(F.count(F.lit(1)).alias("n"), F.avg(eq).alias("agree"), F.count_if(F.col("w") == 1).alias("n_resolved"), F.avg(F.when(F.col("w") == 1, eq)).alias("agree_resolved"))


BM25 = """
lib AS (SELECT d.doc_id, d.text, CAST(l.quality AS VARCHAR) AS class FROM documents d JOIN labels l USING (doc_id)),
tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM lib),
len AS (SELECT doc_id, count(*) AS dl FROM tok GROUP BY 1),
st AS (SELECT (SELECT count(*) FROM lib) AS n, (SELECT count(*) FROM tok) / CAST((SELECT count(*) FROM lib) AS DOUBLE) AS mean),
tf AS (SELECT doc_id, token, count(*) AS tf FROM tok GROUP BY 1, 2),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT DISTINCT item_id AS query, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM benchmark),
raw AS (SELECT q.query, tf.doc_id AS doc, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * dl / mean))) AS raw
  FROM q JOIN tf USING (token) JOIN df USING (token) JOIN len USING (doc_id), st GROUP BY 1, 2),
nrm AS (SELECT query, doc, CASE WHEN max(raw) OVER w - min(raw) OVER w <= 1e-12 THEN 1.0 ELSE (raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w) END AS norm FROM raw WINDOW w AS (PARTITION BY query)),
sc AS (SELECT query, doc, round(norm, 9) AS score, class, row_number() OVER (PARTITION BY query ORDER BY round(norm, 9) DESC, doc DESC) AS rank FROM nrm JOIN lib ON doc = doc_id)
"""


def _scores(spark, d):
    lib = _docs(spark, d).join(table(spark, d, "labels"), "doc_id").select("doc_id", "text", F.col("quality").cast("string").alias("class"))
    raw = R.bm25(table(spark, d, "benchmark"), R.index(lib, "doc_id", "text"), "item_id", "text")
    return R.min_max(raw).withColumn("score", F.round("norm", R.DIGITS)).join(lib.select(F.col("doc_id").alias("doc"), "class"), "doc")


@query(f"WITH {BM25} SELECT query, doc, raw FROM raw", ["raw"])
def r2_bm25(spark, d):
    """Raw BM25 of all items against the labelled documents."""
    lib = _docs(spark, d).join(table(spark, d, "labels").select("doc_id"), "doc_id")
    return R.bm25(table(spark, d, "benchmark"), R.index(lib, "doc_id", "text"), "item_id", "text")


@query(f"WITH {BM25} SELECT query, doc, score, CAST(rank AS INT) AS rank FROM sc WHERE rank <= 4", ["score"])
def w3_top_k(spark, d):
    """The four best of each query; k is the operator."""
    return R.top_k(_scores(spark, d), 4).select("query", "doc", "score", "rank")


@query(f"""WITH {BM25}, c AS (SELECT *, row_number() OVER (PARTITION BY query, class ORDER BY rank) AS in_class FROM sc),
p AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY CAST(in_class > 2 AS INT), rank) AS place FROM c)
SELECT query, doc, class, score, CAST(place AS INT) AS place FROM p WHERE place <= 4""", ["score"])
def w1_quota_top_k(spark, d):
    """At most two of a class first, then by rank."""
    return R.quota_top_k(_scores(spark, d), 4).select("query", "doc", "class", "score", "place")


@query(f"""WITH {BM25}, c AS (SELECT *, row_number() OVER (PARTITION BY query, class ORDER BY rank) AS in_class FROM sc)
SELECT query, doc, class, score FROM c WHERE in_class <= CASE class WHEN '1' THEN 3 WHEN '0' THEN 1 ELSE 0 END""", ["score"])
def w2_profile_top_k(spark, d):
    """Three of one class, one of the other."""
    return R.profile_top_k(_scores(spark, d), {"1": 3, "0": 1}).select("query", "doc", "class", "score")


@query(f"""WITH {BM25}, k AS (SELECT query, class, count(*) AS n FROM sc WHERE rank <= 4 GROUP BY 1, 2),
r AS (SELECT query, doc, class, row_number() OVER (PARTITION BY query, class ORDER BY CAST(('0x' || substr(sha256('draw' || chr(31) || query || chr(31) || doc), 1, 15)) AS BIGINT), doc) AS draw FROM sc)
SELECT r.query, r.doc, r.class, CAST(draw AS INT) AS draw FROM r JOIN k USING (query, class) WHERE draw <= n""")
def r5_random_in_profile(spark, d):
    """Random members of the same classes as the best four."""
    s = _scores(spark, d)
    counts = R.top_k(s, 4).groupBy("query", "class").agg(F.count(F.lit(1)).alias("n"))
    return R.random_in_profile(s, counts, "draw").select("query", "doc", "class", "draw")


VEC = """
q AS (SELECT vec_id AS query, embedding AS qv FROM embeddings WHERE vec_id % 20 = 0),
l AS (SELECT vec_id AS doc, embedding AS v FROM embeddings),
cs AS (SELECT query, doc, list_dot_product(CAST(qv AS DOUBLE[]), CAST(v AS DOUBLE[])) / (sqrt(list_dot_product(CAST(qv AS DOUBLE[]), CAST(qv AS DOUBLE[]))) * sqrt(list_dot_product(CAST(v AS DOUBLE[]), CAST(v AS DOUBLE[])))) AS cos FROM q, l WHERE query <> doc)
"""


def _cosines(spark, d, least=None):
    """Every twentieth vector against all rows but itself."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "embedding")
    return R.dense(q, e.select(F.col("vec_id").alias("doc"), "embedding"), "embedding", least).where("query <> doc")


@query(f"WITH {VEC} SELECT query, doc, cos FROM cs WHERE cos >= 0.2", ["cos"])
def f35_dense(spark, d):
    """Cosine of every twentieth vector with all others, as far as similar enough."""
    return _cosines(spark, d, 0.2)


@query(f"""WITH {VEC}, lx AS (SELECT query, doc, CASE WHEN (query + doc) % 11 = 0 THEN round(1.0 / (1 + doc % 13), 9) ELSE 0.0 END AS score FROM cs),
b AS (SELECT cs.query, cs.doc, cs.cos, round(cs.cos, 9) AS cos9, lx.score FROM cs JOIN lx USING (query, doc) WHERE lx.score > 0 OR round(cs.cos, 9) >= 0.2),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS r1, row_number() OVER (PARTITION BY query ORDER BY cos9 DESC, doc) AS r2 FROM b)
SELECT query, doc, cos, 0.5 / (60 + r1) + 0.5 / (60 + r2) AS score FROM r""", ["cos", "score"])
def r6_hybrid(spark, d):
    """Lexical and dense ranks fused, with abstention."""
    cos = _cosines(spark, d)
    lexical = cos.select("query", "doc", F.when((F.col("query") + F.col("doc")) % 11 == 0, F.round(1.0 / (1 + F.col("doc") % 13), 9)).otherwise(0.0).alias("score"))
    return R.hybrid(lexical, cos, 0.5)


CONV = """
t AS (SELECT conv_id, turn, role, text, lag(text) OVER w AS before_text, lag(role) OVER w AS before_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
cv AS (SELECT conv_id, turn, before_text AS ref, text AS cand FROM t WHERE before_text IS NOT NULL)
"""


def _turns(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").withColumn("ref", F.lag("text").over(w)).where("ref is not null").select("conv_id", "turn", "ref", F.col("text").alias("cand"))


def _words_sql(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '[\\pL\\pN_\\pM]+|[^\\pL\\pN_\\pM\\s]')"


@query(f"""WITH {CONV}, a AS (SELECT conv_id, turn, unnest({_words_sql('ref')}) AS w FROM cv), b AS (SELECT conv_id, turn, unnest({_words_sql('cand')}) AS w FROM cv),
ca AS (SELECT conv_id, turn, w, count(*) AS n FROM a GROUP BY ALL), cb AS (SELECT conv_id, turn, w, count(*) AS n FROM b GROUP BY ALL),
hit AS (SELECT conv_id, turn, sum(least(ca.n, cb.n)) AS h FROM ca JOIN cb USING (conv_id, turn, w) GROUP BY ALL),
la AS (SELECT conv_id, turn, sum(n) AS n FROM ca GROUP BY ALL), lb AS (SELECT conv_id, turn, sum(n) AS n FROM cb GROUP BY ALL)
SELECT cv.conv_id, cv.turn, coalesce(2.0 * h / (la.n + lb.n), 0) AS f1 FROM cv LEFT JOIN hit USING (conv_id, turn) LEFT JOIN la USING (conv_id, turn) LEFT JOIN lb USING (conv_id, turn)""", ["f1"])
def f13_rouge1(spark, d):
    """F9, F13, A43."""
    return _turns(spark, d).select("conv_id", "turn", M.rouge1_f1(F.col("ref"), F.col("cand")).alias("f1"))


# Tokens of both sides by kind (characters, words, words by white space), their n-grams with counts, and clipped matches.
GRAMS = rf"""{CONV.strip()},
side AS (SELECT conv_id, turn, 'ref' AS side, ref AS text FROM cv UNION ALL SELECT conv_id, turn, 'cand', cand FROM cv),
tok AS (SELECT conv_id, turn, side, 'c' AS kind, regexp_extract_all(regexp_replace(text, '\s', '', 'g'), '(?s).') AS t FROM side
  UNION ALL SELECT conv_id, turn, side, 'w', {_words_sql('text')} FROM side UNION ALL SELECT conv_id, turn, side, 's', regexp_extract_all(text, '\S+') FROM side),
len AS (SELECT conv_id, turn, kind, max(len(t)) FILTER (WHERE side = 'ref') AS nr, max(len(t)) FILTER (WHERE side = 'cand') AS nc FROM tok GROUP BY ALL),
place AS (SELECT conv_id, turn, side, kind, t, n, unnest(range(1, len(t) - n + 2)) AS i FROM tok, range(1, 5) AS o(n)),
gram AS (SELECT conv_id, turn, side, kind, n, array_to_string(t[i : i + n - 1], chr(31)) AS g, count(*) AS k FROM place GROUP BY ALL),
hit AS (SELECT a.conv_id, a.turn, a.kind, a.n, sum(least(a.k, b.k)) AS h FROM gram a JOIN gram b USING (conv_id, turn, kind, n, g) WHERE a.side = 'ref' AND b.side = 'cand' GROUP BY ALL),
ord AS (SELECT len.*, n, greatest(0, nr - n + 1) AS tr, greatest(0, nc - n + 1) AS tc, CAST(coalesce(h, 0) AS BIGINT) AS h FROM len CROSS JOIN range(1, 5) AS o(n) LEFT JOIN hit USING (conv_id, turn, kind, n))"""


@query(f"""WITH {GRAMS}, m AS (SELECT conv_id, turn, kind, any_value(nr) AS nr, any_value(nc) AS nc, least(1, exp(1 - any_value(nr) / CAST(greatest(1, any_value(nc)) AS DOUBLE))) AS brevity,
exp(sum(ln(CASE WHEN h > 0 THEN h / CAST(greatest(1, tc) AS DOUBLE) ELSE 1e-9 END)) / 4) AS plain, exp(sum(CASE WHEN tc > 0 THEN ln(CASE WHEN h > 0 THEN h / CAST(tc AS DOUBLE) ELSE 1e-9 END) ELSE 0 END) / 4) AS skipping,
exp(sum(ln(CASE WHEN h > 0 THEN h ELSE 0.1 END / CAST(greatest(1, tc) AS DOUBLE))) / 4) AS smooth, max(CASE WHEN n = 1 THEN h END) AS first, sum(h) / CAST(greatest(1, sum(tr), sum(tc)) AS DOUBLE) AS pooled,
coalesce(avg(CASE WHEN tr > 0 AND tc > 0 THEN h / CAST(greatest(tr, tc) AS DOUBLE) END), 0) AS lesser FROM ord GROUP BY ALL), z AS (SELECT *, nr > 0 AND nc > 0 AS told FROM m)
SELECT conv_id, turn, max(CASE WHEN kind = 'c' THEN CASE WHEN told THEN brevity * plain ELSE 0 END END) AS bleu_chars, max(CASE WHEN kind = 'w' THEN CASE WHEN told THEN brevity * plain ELSE 0 END END) AS bleu_words,
max(CASE WHEN kind = 'w' THEN CASE WHEN told THEN brevity * skipping ELSE 0 END END) AS proxy, max(CASE WHEN kind = 'c' THEN CASE WHEN told AND first > 0 THEN brevity * smooth ELSE 0 END END) AS smoothed,
max(CASE WHEN kind = 's' THEN CASE WHEN told THEN pooled ELSE 0 END END) AS gleu, max(CASE WHEN kind = 'w' THEN lesser END) AS gleu_like FROM z GROUP BY conv_id, turn""", ["bleu_chars", "bleu_words", "proxy", "smoothed", "gleu", "gleu_like"])
def f10_text_metrics(spark, d):
    """Metrics of a turn against the one before."""
    r, c = F.col("ref"), F.col("cand")
    t = _turns(spark, d)
    return t.select("conv_id", "turn", M.bleu_chars(r, c).alias("bleu_chars"), M.bleu_words(r, c).alias("bleu_words"), M.sentence_bleu_proxy(r, c).alias("proxy"), M.bleu_smoothed_chars(r, c).alias("smoothed"), M.sentence_gleu(r, c).alias("gleu"), M.gleu_like(r, c).alias("gleu_like"))


@query()
def f14_rouge(spark, d):
    """stemmed overlap of a turn with the one before; hand-computed cases are in the tests."""
    return _turns(spark, d).select("conv_id", "turn", M.rouge(F.col("ref"), F.col("cand")).alias("r")).select("conv_id", "turn", "r.*")


# Sums for corpus BLEU by parity of the turn and conversation.
BLEU_SUMS = f"""{GRAMS}, sums AS (SELECT turn % 2 AS part, conv_id, sum(CASE WHEN n = 1 THEN nr END) AS nr, sum(CASE WHEN n = 1 THEN nc END) AS nc,
{', '.join(f"sum(CASE WHEN n = {n} THEN h END) AS m{n}, sum(CASE WHEN n = {n} THEN tc END) AS t{n}" for n in range(1, 5))} FROM ord WHERE kind = 'w' GROUP BY ALL)"""
_BLEU = "CASE WHEN least(sum(m1), sum(m2), sum(m3), sum(m4)) > 0 THEN 100 * exp(least(0, 1 - sum(nr) / CAST(sum(nc) AS DOUBLE)) + (ln(sum(m1) / CAST(sum(t1) AS DOUBLE)) + ln(sum(m2) / CAST(sum(t2) AS DOUBLE)) + ln(sum(m3) / CAST(sum(t3) AS DOUBLE)) + ln(sum(m4) / CAST(sum(t4) AS DOUBLE))) / 4) ELSE 0 END"


@query(f"""WITH {BLEU_SUMS} SELECT part, {_BLEU} AS bleu FROM sums GROUP BY part""", ["bleu"])
def a42_corpus_bleu(spark, d):
    """Corpus BLEU by role from summed statistics."""
    t = _turns(spark, d).withColumn("part", F.col("turn") % 2)
    sums = t.select("part", M.bleu_statistics(F.col("ref"), F.col("cand")).alias("s")).select("part", "s.*").groupBy("part").agg(*[F.sum(n).alias(n) for n in M.SUMS])
    return sums.select("part", M.corpus_bleu({n: F.col(n) for n in M.SUMS}).alias("bleu"))


@query(rf"""WITH {CONV.strip()}, side AS (SELECT conv_id, turn, 'ref' AS side, ref AS text FROM cv UNION ALL SELECT conv_id, turn, 'cand', cand FROM cv),
tok AS (SELECT conv_id, turn, side, 'c' AS kind, 6 AS most, regexp_extract_all(regexp_replace(text, '\s', '', 'g'), '(?s).') AS t FROM side UNION ALL
  SELECT conv_id, turn, side, 'p', 2, flatten(list_transform(regexp_extract_all(text, '\S+'), lambda w: CASE WHEN length(w) > 1 AND regexp_matches(w, '[[:punct:]]$') THEN [w[:-2], w[-1]] WHEN length(w) > 1 AND regexp_matches(w, '^[[:punct:]]') THEN [w[1], w[2:]] ELSE [w] END)) FROM side),
place AS (SELECT conv_id, turn, side, kind, t, n, unnest(range(1, len(t) - n + 2)) AS i FROM tok, range(1, 7) AS o(n) WHERE n <= most),
gram AS (SELECT conv_id, turn, side, kind, n, array_to_string(t[i : i + n - 1], chr(31)) AS g, count(*) AS k FROM place GROUP BY ALL),
hit AS (SELECT a.turn % 2 AS part, a.kind, a.n, sum(least(a.k, b.k)) AS h FROM gram a JOIN gram b USING (conv_id, turn, kind, n, g) WHERE a.side = 'ref' AND b.side = 'cand' GROUP BY ALL),
one AS (SELECT conv_id, turn, kind, n, coalesce(sum(k) FILTER (WHERE side = 'ref'), 0) AS r, coalesce(sum(k) FILTER (WHERE side = 'cand'), 0) AS c FROM gram GROUP BY ALL),
tot AS (SELECT turn % 2 AS part, kind, n, sum(r) AS r, sum(CASE WHEN r > 0 THEN c ELSE 0 END) AS c FROM one GROUP BY ALL),
pr AS (SELECT part, avg(coalesce(h, 0) / CAST(c AS DOUBLE)) AS p, avg(coalesce(h, 0) / CAST(r AS DOUBLE)) AS q FROM tot LEFT JOIN hit USING (part, kind, n) WHERE r > 0 AND c > 0 GROUP BY part)
SELECT part, coalesce(100 * 5 * p * q / nullif(4 * p + q, 0), 0) AS chrf FROM pr""", ["chrf"])
def a42_corpus_chrf(spark, d):
    """Corpus chrF++ by role from summed statistics."""
    t = _turns(spark, d).withColumn("part", F.col("turn") % 2)
    sums = t.select("part", M.chrf_statistics(F.col("ref"), F.col("cand")).alias("s")).select("part", "s.*").groupBy("part").agg(*[F.sum(n).alias(n) for n in M.CHRF_SUMS])
    return sums.select("part", M.corpus_chrf({n: F.col(n) for n in M.CHRF_SUMS}).alias("chrf"))


@query(f"""WITH {BLEU_SUMS}, k AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY conv_id) - 1 AS place, count(*) OVER (PARTITION BY part) AS n FROM sums),
s AS (SELECT part, max(n) AS n FROM k GROUP BY 1), rep AS (SELECT part, b, {DRAW.format(seed=13)} AS place FROM s, range(2000) t(b), LATERAL (SELECT unnest(range(n)) AS i) u),
x AS (SELECT part, b, {_BLEU} AS x FROM rep JOIN k USING (part, place) GROUP BY 1, 2)
SELECT part, quantile_cont(x, 0.025) AS ci_low, quantile_cont(x, 0.975) AS ci_high FROM x GROUP BY part""", ["ci_low", "ci_high"])
def t9_corpus_bleu(spark, d):
    """The interval of corpus BLEU by role, conversations resampled, from summed statistics."""
    from quillmill.operators import stats as St

    t = _turns(spark, d).withColumn("part", F.col("turn") % 2)
    sums = t.select("part", "conv_id", M.bleu_statistics(F.col("ref"), F.col("cand")).alias("s")).select("part", "conv_id", "s.*").groupBy("part", "conv_id").agg(*[F.sum(n).alias(n) for n in M.SUMS])
    return St.clustered_statistic(sums, ["part"], "conv_id", list(M.SUMS), M.corpus_bleu({n: F.col(n) for n in M.SUMS}), 2000, 13)


@query(f"""WITH {CONV}, g AS (SELECT conv_id, turn, list_distinct({_words_sql('ref')}) AS a, list_distinct({_words_sql('cand')}) AS b FROM cv)
SELECT conv_id, turn, CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE) END AS jaccard FROM g""", ["jaccard"])
def f19_jaccard(spark, d):
    """F19."""
    return _turns(spark, d).select("conv_id", "turn", T.ngram_jaccard(T.language_aware_tokens(F.col("ref")), T.language_aware_tokens(F.col("cand")), 1).alias("jaccard"))


@query(f"""WITH {CONV} SELECT conv_id, turn, CASE WHEN trim(cand) = '' THEN 'empty' WHEN contains(lower(cand), '<think>') OR contains(lower(cand), '</think>') OR contains(lower(cand), '```') THEN 'format'
WHEN ref <> '' AND length(regexp_replace(replace(lower(cand), 'ß', 'ss'), '\\s', '', 'g')) > 1.5 * length(regexp_replace(replace(lower(ref), 'ß', 'ss'), '\\s', '', 'g')) + 8 THEN 'length' ELSE 'valid' END AS reason FROM cv""")
def p10_pair_validity(spark, d):
    """Ordered reasons."""
    why = rules.pair_reason(F.col("ref"), F.col("cand"), F.lit("stop"))
    return _turns(spark, d).select("conv_id", "turn", F.coalesce(why, F.lit("valid")).alias("reason"))


@query(f"""WITH {CONV} SELECT conv_id, turn, CASE WHEN trim(cand) = '' OR cand = ref THEN 'empty_or_identical' WHEN s1 - s0 <= 0.01 THEN 'insufficient_quality_gain'
WHEN length(cand) > 1.5 * greatest(1, length(ref)) + 8 THEN 'hard_length_limit' WHEN length(cand) > 1.02 * greatest(1, length(ref)) + 8 AND s1 - s0 <= 0.05 THEN 'expansion_without_strong_gain' ELSE 'quality_gain' END AS reason,
length(cand) <= 1.5 * length(ref) + 8 AND cand <> ref AND trim(cand) <> '' AS admissible
FROM (SELECT *, (length(ref) % 10) / 10.0 AS s0, (length(cand) % 10) / 10.0 AS s1 FROM cv)""")
def p16_quality_gate(spark, d):
    """P14, P16, P18."""
    score = lambda c: F.length(c) % 10 / 10.0
    r, c = F.col("ref"), F.col("cand")
    return _turns(spark, d).select("conv_id", "turn", rules.quality_gate(r, c, score(r), score(c))["reason"].alias("reason"), rules.admissible(r, c).alias("admissible"))


@query("""WITH u AS (SELECT conv_id, turn, text, CAST(floor(len(regexp_extract_all(text, '[A-Za-z0-9]+')) * CAST(1.3 AS DOUBLE)) + 8 AS BIGINT) AS n FROM conversations),
s AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM u), k AS (SELECT conv_id, turn FROM s WHERE used <= 200)
SELECT conv_id, turn FROM k""")
def f27_packing(spark, d):
    """whole units in order up to a budget; stopping at the first that doesn't fit is a prefix of a running sum."""
    u = table(spark, d, "conversations").withColumn("n", T.approx_tokens(F.col("text")))
    used = F.sum("n").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return u.withColumn("used", used).where("used <= 200").select("conv_id", "turn")


@query("""SELECT page_id, CASE WHEN contains(url, '://') THEN split_part(split_part(url, '://', 2), '/', 1) ELSE '' END AS host FROM pages""")
def f37_path_parts(spark, d):
    """parts of paths."""
    return table(spark, d, "pages").select("page_id", F.when(F.contains("url", F.lit("://")), F.get(F.split(F.get(F.split("url", "://", 2), F.lit(1)), "/"), F.lit(0))).otherwise("").alias("host"))


@query("""SELECT doc_id, CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS BIGINT) AS filtered_index, CAST((row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 16 AS BIGINT) AS batch FROM documents WHERE source <> 'src0'""")
def s6_filtered_index(spark, d):
    """Rows numbered anew behind a filter, in batches of 16."""
    from quillmill.sources.readers import filtered_index

    f = filtered_index(_docs(spark, d).select("doc_id", "lang", "source"), F.col("source") != "src0", "doc_id", ["lang"])
    return S.in_batches(f, ["doc_id"], 16, ["lang"]).select("doc_id", "filtered_index", "batch")


@query()
def r10_self_consistent(spark, d):
    """Of each conversation's turns the most central one; a conversation's candidates are few by definition."""
    from quillmill.operators import graph as G

    return G.self_consistent(table(spark, d, "conversations"), "conv_id", "turn", "text")


@query("""SELECT event_id, '$.event_type' AS path, event_type AS value FROM events WHERE event_type IS NOT NULL UNION ALL SELECT event_id, '$.inner.p', props FROM events WHERE props IS NOT NULL""")
def f38_json_texts(spark, d):
    """All strings of a JSON value with their paths, by a table function."""
    from pyspark.sql.functions import lit

    spark.udtf.register("json_texts", T.JsonTexts)
    table(spark, d, "events").select("event_id", F.to_json(F.struct("event_type", F.struct(F.col("props").alias("p")).alias("inner"))).alias("j")).createOrReplaceTempView("quillmill_events_json")
    return spark.sql("SELECT event_id, t.path, t.value FROM quillmill_events_json, LATERAL json_texts(j) AS t")


# Of each turn, wrapped in what the operator takes away again.
ANSWERS = """a AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(CASE turn % 4 WHEN 0 THEN '<think>aside' || chr(10) || '</think> ' || text WHEN 1 THEN 'Draft first. Summary: "' || text || '"' WHEN 2 THEN text || '<think>cut off' ELSE text END, '(?s)<think>.*?</think>', '', 'g'), '(?s)<think>.*$', '')) AS t FROM conversations)"""
_MARKED = "t"
for _m in T.MARKERS:
    _MARKED = f"(SELECT CASE WHEN contains(x, '{_m}') THEN trim(string_split(x, '{_m}')[-1]) ELSE x END FROM (SELECT {_MARKED} AS x))"


@query(f"""WITH {ANSWERS} SELECT conv_id, turn, regexp_replace(regexp_replace(trim({_MARKED}), '^"+', ''), '"+$', '') AS answer FROM a""")
def f20_answer(spark, d):
    """answers without thinking, what stands before a marker, and quotes."""
    k = F.col("turn") % 4
    said = F.when(k == 0, F.concat(F.lit("<think>aside\n</think> "), "text")).when(k == 1, F.concat(F.lit('Draft first. Summary: "'), "text", F.lit('"'))).when(k == 2, F.concat("text", F.lit("<think>cut off"))).otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.answer(said).alias("answer"))

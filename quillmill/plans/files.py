"""Queries over sources, sinks and ingestion: tables go out to fresh folders in a format and come back through its reader.

Files that must be whole (a run, a record) hold what belongs to one nation or region, of which there are ever the same
number; tables that grow are written and read in parts.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.operators import intervals as V
from quillmill.plans.registry import query
from quillmill.sources import readers, writers
from quillmill.sources.scratch import fresh_path
from quillmill.streaming import ingest

ORDER = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()), T.StructField("o_orderpriority", T.StringType())])
NATION = T.StructType([T.StructField("n_nationkey", T.LongType()), T.StructField("n_name", T.StringType())])


def _orders(spark, d):
    return readers.table(spark, d, "orders").select(F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long"), "o_orderpriority")


def _nations(spark, d):
    return readers.table(spark, d, "nation").select(F.col("n_nationkey").cast("long"), "n_name", F.col("n_regionkey").cast("long"))


def _region_files(spark, d, lines):
    """One file for each region, its nations' lines (a column) in order, the last without an end; gives the folder."""
    path = fresh_path(spark, "lines")
    one = _nations(spark, d).groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", lines.alias("line")))).alias("x"))
    whole = one.select("n_regionkey", F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("value"))
    whole.write.partitionBy("n_regionkey").option("lineSep", " ").text(path)
    return path


def _region_of(path):
    return F.regexp_extract(path, r"n_regionkey=(\d+)", 1).cast("long").alias("region")


@query("""SELECT CAST(o_orderkey AS BIGINT) AS key, o_orderpriority AS priority, CAST(o_custkey AS BIGINT) AS customer FROM orders""")
def s2_nested_parquet(spark, d):
    """Parquet that is written once, of whose nested fields the scan takes some."""
    path = fresh_path(spark, "nested")
    writers.write_once(_orders(spark, d).select(F.struct("o_orderkey", F.struct("o_orderpriority", "o_custkey").alias("inner"), F.lit("hidden").alias("reference")).alias("record")), path)
    return readers.projected(spark.read.parquet(path), {"key": "record.o_orderkey", "priority": "record.inner.o_orderpriority", "customer": "record.inner.o_custkey"})


@query("""SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, split, CAST(row_number() OVER (ORDER BY turn, o_orderkey) - 1 AS BIGINT) AS global_index
FROM (SELECT o_orderkey, CASE o_custkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'dev' ELSE 'test' END AS split, o_custkey % 3 AS turn FROM orders)""")
def s4_global_index(spark, d):
    """An index that runs on over all splits."""
    o = _orders(spark, d)
    parts = {name: o.where(F.col("o_custkey") % 3 == k).select("o_orderkey") for k, name in enumerate(("train", "dev", "test"))}
    return readers.with_global_index(parts, "o_orderkey")


@query("""SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS filtered_index, (row_number() OVER (ORDER BY o_orderkey) - 1) // 16 AS batch FROM orders WHERE o_orderstatus <> 'F'""")
def s7_one_index(spark, d):
    """Rows that a filter keeps, numbered anew over the whole table, in batches of 16."""
    from quillmill.operators.sampling import in_batches

    kept = readers.filtered_index(readers.table(spark, d, "orders"), F.col("o_orderstatus") != "F", "o_orderkey").select(F.col("o_orderkey").cast("long"), "filtered_index")
    return in_batches(kept, ["o_orderkey"], 16)


@query("""SELECT CAST(doc_id AS VARCHAR) AS doc_id, nullif(text, '') AS text, CASE WHEN doc_id % 2 = 0 THEN lang END AS lang, CASE WHEN doc_id % 2 = 1 THEN nullif(source, '') END AS source FROM documents""")
def s8_csv(spark, d):
    """Tables of unlike columns as one CSV with a byte-order mark, quotes and line breaks in texts, read again."""
    x = readers.table(spark, d, "documents").select(F.col("doc_id").alias("﻿doc_id"), "text", "lang", "source")
    path = fresh_path(spark, "csv")
    even = F.col("﻿doc_id") % 2 == 0
    writers.write_csv([x.where(even).drop("source"), x.where(~even).drop("lang")], path)
    return readers.csv(spark, path, ["doc_id", "text", "lang", "source"])


_PAIRS = """p AS (SELECT o_orderkey, trim(coalesce(CASE WHEN o_orderkey % 5 <> 0 THEN ' ' || o_orderpriority END, '')) AS wrong, trim(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE o_orderstatus || ' ' END) AS gold FROM orders)"""


def _contrast(spark, d):
    wrong = F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit(" "), "o_orderpriority"))
    gold = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise(F.concat("o_orderstatus", F.lit(" ")))
    return readers.contrastive(readers.table(spark, d, "orders").select("o_orderkey", wrong.alias("wrong"), gold.alias("gold")), ["wrong", "gold"], "wrong", "gold")


@query(f"""WITH {_PAIRS} SELECT o_orderkey, wrong, gold FROM p WHERE wrong <> '' AND gold <> '' AND wrong <> gold""")
def s10_contrastive(spark, d):
    """Rows with a contrast."""
    return _contrast(spark, d)[0]


@query(f"""WITH {_PAIRS} SELECT count_if(wrong = '' OR gold = '') AS empty, count_if(wrong <> '' AND gold <> '' AND wrong = gold) AS no_contrast, count(*) AS rows FROM p""")
def s10_left_out(spark, d):
    """What the contrast leaves out."""
    return _contrast(spark, d)[1]


@query("""SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey, o_orderpriority FROM orders""")
def s12_json(spark, d):
    """JSON lines in order, read strictly."""
    path = fresh_path(spark, "json")
    writers.write_jsonl(_orders(spark, d), path, "o_orderkey")
    return readers.json_strict(spark, path, ORDER)


@query("""SELECT bad, count(*) AS n, CAST(sum(CASE WHEN NOT bad THEN o_orderkey ELSE 0 END) AS BIGINT) AS keys FROM (SELECT o_orderkey, o_orderkey % 7 IN (0, 1) AS bad FROM orders) GROUP BY 1""")
def s13_tolerant(spark, d):
    """Lines that don't parse or lack their list are counted as bad."""
    good = F.to_json(F.struct("o_orderkey", F.array("o_custkey").alias("rounds")))
    line = F.when(F.col("o_orderkey") % 7 == 0, F.substring(good, 1, 9)).when(F.col("o_orderkey") % 7 == 1, F.to_json(F.struct("o_orderkey"))).otherwise(good)
    path = fresh_path(spark, "tolerant")
    _orders(spark, d).select(line.alias("value")).write.text(path)
    rows = readers.json_tolerant(spark, path, T.StructType().add("o_orderkey", "long").add("rounds", T.ArrayType(T.LongType())), "rounds")
    return rows.groupBy("bad").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("bad"), 0).otherwise(F.col("o_orderkey"))).alias("keys"))


@query("""WITH l AS (SELECT n_regionkey, n_nationkey, n_name, row_number() OVER w AS line_no, row_number() OVER w = count(*) OVER (PARTITION BY n_regionkey) AS last FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey))
SELECT CAST(n_regionkey AS BIGINT) AS region, line_no, CASE WHEN n_nationkey % 5 = 0 THEN 'blank' WHEN n_nationkey % 5 = 1 THEN CASE WHEN last THEN 'truncated' ELSE 'bad' END ELSE 'ok' END AS status,
CASE WHEN n_nationkey % 5 > 1 THEN n_name END AS name FROM l""")
def s14_lines(spark, d):
    """Lines of files with their numbers, blank, broken and cut off ones."""
    good = F.to_json(F.struct("n_nationkey", "n_name"))
    kind = F.col("n_nationkey") % 5
    path = _region_files(spark, d, F.when(kind == 0, " ").when(kind == 1, F.substring(good, 1, 12)).otherwise(good))
    lines = readers.json_lines(spark, path, NATION)
    return lines.select(_region_of("path"), F.col("line_no").cast("long"), "status", F.col("row.n_name").alias("name"))


@query("""SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation""")
def s15_required(spark, d):
    """Rows of files all of whose lines must parse."""
    return readers.require_ok(readers.json_lines(spark, _region_files(spark, d, F.to_json(F.struct("n_nationkey", "n_name"))), NATION))


@query("""SELECT CAST(n_regionkey AS BIGINT) AS region, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS BIGINT) AS line_no, n_name AS name, n_nationkey % 3 = 0 AS repaired FROM nation""")
def s16_repaired(spark, d):
    """Lines with NUL bytes, parsed without them."""
    good = F.to_json(F.struct("n_nationkey", "n_name"))
    torn = F.concat(F.substring(good, 1, 4), F.lit("\0"), F.expr("substring(to_json(struct(n_nationkey, n_name)), 5)"))
    rows = readers.nul_repaired(spark, _region_files(spark, d, F.when(F.col("n_nationkey") % 3 == 0, torn).otherwise(good)), NATION)
    return rows.select(_region_of("path"), F.col("line_no").cast("long"), F.col("row.n_name").alias("name"), "repaired")


RUN = T.StructType([T.StructField(c, T.StringType()) for c in ("task", "model", "sample_id")])


def _run_files(spark, d):
    """A run for each region, in folders arm__tag of a split; the last region's mixes models."""
    path = fresh_path(spark, "runs")
    for region, folder in enumerate(("train/a", "train/a__t1", "dev/b", "dev/b__t1", "test/c__t2")):
        rows = _nations(spark, d).where(F.col("n_regionkey") == region)
        model = F.when(F.lit(region == 4) & (F.col("n_nationkey") % 2 == 0), "n").otherwise("m")
        rows.select(F.lit(f"task{region % 2}").alias("task"), model.alias("model"), F.col("n_name").alias("sample_id")).coalesce(1).write.json(f"{path}/{folder}")
    return path


_RUNS = """runs AS (SELECT CAST(n_regionkey AS BIGINT) AS region, count(*) AS n FROM nation GROUP BY 1),
named AS (SELECT *, CASE WHEN region < 2 THEN 'a' WHEN region < 4 THEN 'b' ELSE 'c' END AS arm, CASE WHEN region IN (1, 3) THEN 't1' WHEN region = 4 THEN 't2' ELSE '' END AS tag,
CASE WHEN region < 2 THEN 'train' WHEN region < 4 THEN 'dev' ELSE 'test' END AS split, 'task' || region % 2 AS task,
(SELECT count(DISTINCT n_nationkey % 2) FROM nation WHERE n_regionkey = 4) = 1 OR region < 4 AS consistent FROM runs)"""


@query(f"""WITH {_RUNS} SELECT arm, tag, split, task, n, consistent FROM named""")
def s17_discover(spark, d):
    """What paths and records say of runs."""
    return readers.discover(spark, f"{_run_files(spark, d)}/*/*/*.json", RUN).select("arm", "tag", "split", "task", "n", "consistent")


@query(f"""WITH {_RUNS} SELECT arm, tag, task FROM named WHERE n >= CASE task WHEN 'task0' THEN 5 ELSE 6 END""")
def s18_complete(spark, d):
    """Runs with all samples of their task."""
    runs = readers.discover(spark, f"{_run_files(spark, d)}/*/*/*.json", RUN)
    return readers.complete(runs, {"task0": 5, "task1": 6}).select("arm", "tag", "task")


@query("""SELECT n_name AS sample_id, 'task' || n_regionkey % 2 AS task FROM nation WHERE n_regionkey NOT IN (1, 3)""")
def s20_listed(spark, d):
    """Records of the files that a manifest names, and of no other."""
    found = readers.file_inventory(spark, _run_files(spark, d), "*.json", "__t1/")
    return readers.listed(spark, found.select("path"), RUN).select("sample_id", "task")


@query("""SELECT CAST(n_nationkey AS BIGINT) AS nation, CAST(length(n_name) + 1 AS BIGINT) AS length, sha256(n_name || chr(10)) AS sha256 FROM nation WHERE n_nationkey <> 7""")
def s22_inventory(spark, d):
    """Files of a folder with sizes and hashes, but for those that a pattern excludes."""
    path = fresh_path(spark, "inventory")
    _nations(spark, d).select("n_nationkey", F.col("n_name").alias("value")).repartition("n_nationkey").write.partitionBy("n_nationkey").text(path)
    found = readers.file_inventory(spark, path, "*.txt", "n_nationkey=7/")
    return found.select(F.regexp_extract("path", r"n_nationkey=(\d+)", 1).cast("long").alias("nation"), "length", "sha256")


@query("""SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey, o_orderpriority, (SELECT count(*) FROM orders) AS n FROM orders""")
def s23_manifest(spark, d):
    """A library that is written in order, hashed as read back, published in one step and loaded."""
    staging, public = fresh_path(spark, "staging"), fresh_path(spark, "public")
    n, _ = writers.write_manifest(_orders(spark, d), f"{staging}/library", "o_orderkey")
    writers.publish(spark, f"{staging}/library", f"{public}/library")
    return writers.read_manifest(spark, f"{public}/library", ORDER).withColumn("n", F.lit(n).cast("long"))


@query("""SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN -CAST(o_orderkey AS BIGINT) ELSE 1 END AS position FROM orders""")
def s29_manifest_order(spark, d):
    """Rows by their place in a manifest, unknown ones last."""
    o = _orders(spark, d).select("o_orderkey")
    return writers.in_manifest_order(o, o.where("o_orderkey % 4 <> 0").withColumn("position", -F.col("o_orderkey")), "o_orderkey", "position").fillna(1, ["position"])


@query("""WITH p AS (SELECT CAST(o_orderkey AS BIGINT) AS id, o_orderpriority AS first, o_orderstatus AS second, substr(sha256('review' || CAST(o_orderkey AS BIGINT)), 1, 1) < '8' AS flip FROM orders)
SELECT CAST(id AS VARCHAR) AS id, CASE WHEN flip THEN first ELSE second END AS a, CASE WHEN flip THEN second ELSE first END AS b, CASE WHEN flip THEN 'P' ELSE 'Q' END AS arm_of_a FROM p""")
def s33_review(spark, d):
    """A blinded sheet and its key, joined again."""
    path = fresh_path(spark, "review")
    o = readers.table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("id"), F.col("o_custkey").alias("source"), F.col("o_orderpriority").alias("first"), F.col("o_orderstatus").alias("second"), F.lit("P").alias("first_arm"), F.lit("Q").alias("second_arm"))
    writers.review_package(o, path, "review")
    key = spark.read.schema("id string, arm_of_a string").json(f"{path}/key")
    return readers.csv(spark, f"{path}/sheet", ["id", "a", "b"]).join(key, "id")


def _records(spark, d):
    """A JSON record a nation, each a file of its own: an unfinished, a changed, an equal and a blank candidate."""
    path = fresh_path(spark, "records")
    texts = ((F.lit("half"), "length"), (F.concat("n_name", F.lit("!")), "stop"), (F.col("n_name"), "stop"), (F.lit(" "), "stop"))
    each = F.array(*[F.struct(t.alias("text"), F.lit(reason).alias("finish_reason"), F.lit(k).alias("slot"), F.lit(0.5).alias("temperature")) for k, (t, reason) in enumerate(texts)])
    record = F.struct(F.lit("train").alias("split"), F.col("n_nationkey").cast("string").alias("source_id"), F.lit("nation").alias("source"), F.concat(F.lit("g"), F.col("n_regionkey").cast("string")).alias("generator"), F.col("n_name").alias("current"), each.alias("candidates"))
    _nations(spark, d).select("n_nationkey", F.to_json(record).alias("value")).repartition("n_nationkey").write.partitionBy("n_nationkey").text(f"{path}/txt")
    # the ingestion reads *.json: the same files under such names
    files = spark.read.text(f"{path}/txt", wholetext=True)
    files.select("n_nationkey", F.from_json("value", ingest.RECORD).alias("r")).select("n_nationkey", "r.*").repartition("n_nationkey").write.partitionBy("n_nationkey").json(f"{path}/raw")
    return f"{path}/raw"


_OCCURRENCES = """occ AS (SELECT 'g' || n_regionkey AS generator, n_name AS current, slot, CASE slot WHEN 0 THEN 'half' WHEN 1 THEN n_name || '!' WHEN 2 THEN n_name ELSE ' ' END AS candidate, CASE slot WHEN 0 THEN 'length' WHEN 3 THEN 'empty' ELSE 'valid' END AS reason, CAST(n_nationkey AS VARCHAR) AS source_id FROM nation, range(4) s(slot))"""


@query(f"""WITH {_OCCURRENCES} SELECT generator, current, CAST(slot AS INT) AS slot, candidate, reason, sha256(source_id || chr(31) || current || chr(31) || candidate) AS pair_id FROM occ""")
def x1_ingest_stream(spark, d):
    """Files by a stream in micro-batches; a second run over the same files adds nothing."""
    raw, folder = _records(spark, d), fresh_path(spark, "ingested")
    ingest.ingest_stream(spark, raw, f"{folder}/store", f"{folder}/checkpoint", 8)
    store = ingest.ingest_stream(spark, raw, f"{folder}/store", f"{folder}/checkpoint-2", 8)
    return store.read("occurrences", ingest.OCCURRENCES).select("generator", "current", "slot", "candidate", "reason", "pair_id")


@query(f"""WITH {_OCCURRENCES} SELECT generator, current, candidate FROM occ WHERE reason = 'valid' AND current <> candidate""")
def x2_ingest_all(spark, d):
    """The distinct valid pairs of a whole folder at once."""
    store = ingest.ingest_all(spark, _records(spark, d), fresh_path(spark, "ingested"))
    return store.read("pairs", ingest.PAIRS).select("generator", "current", "candidate")


@query("""SELECT CAST(n_nationkey AS BIGINT) AS nation, CASE WHEN n_nationkey % 6 = 0 THEN 'unread' WHEN n_nationkey % 6 = 1 THEN 'missing' WHEN n_nationkey % 6 = 2 THEN 'changed' ELSE 'ok' END AS status FROM nation""")
def x12_integrity(spark, d):
    """The ledger against the files that are there."""
    raw, folder = _records(spark, d), fresh_path(spark, "ingested")
    nation = F.regexp_extract("path", r"n_nationkey=(\d+)", 1).cast("long")
    kind = nation % 6
    store = ingest.Store(spark, folder)
    there = readers.file_inventory(spark, raw, "*.json").select("path", "sha256").where(kind > 0)
    ledger = there.select(F.when(kind == 1, F.concat("path", F.lit(".gone"))).otherwise(F.col("path")).alias("path"), F.when(kind == 2, F.lit("other")).otherwise(F.col("sha256")).alias("sha256"))
    store.commit({"ledger": ledger})
    found = ingest.integrity(store, raw).withColumn("nation", nation)
    return found.where(~((kind == 1) & (F.col("status") == "unread"))).select("nation", "status")


@query("""SELECT unit, birth_batch, CAST(CASE WHEN birth_batch < 0 THEN 0 ELSE 1 + 5 * birth_batch END AS BIGINT) AS seen FROM
(SELECT 'start' AS unit, CAST(-1 AS BIGINT) AS birth_batch UNION ALL SELECT n_name, (row_number() OVER (ORDER BY n_nationkey) - 1) // 5 FROM nation)""")
def x8_micro_batches(spark, d):
    """Batches of five, each of which sees the library as it was before it."""
    schema = "unit string, birth_batch long, seen long"
    start = spark.createDataFrame([("start", -1, 0)], schema)

    def step(batch, library):
        size = library.agg(F.count(F.lit(1)).alias("seen"))
        return batch.crossJoin(F.broadcast(size)).select(F.col("n_name").alias("unit"), F.col("batch").alias("birth_batch"), "seen")

    return ingest.micro_batches(_nations(spark, d), "n_nationkey", 5, start, step, ingest.Store(spark, fresh_path(spark, "library")), schema)


@query("""SELECT count(*) > 0 AND bool_and(n >= 3 AND retained >= 1) AS done FROM (SELECT o_orderstatus, count(*) AS n, count_if(o_totalprice > 1000) AS retained FROM orders GROUP BY 1)""")
def x6_finished(spark, d):
    """Whether all tasks have reached their prefix and their target."""
    p = readers.table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("task")).agg(F.count(F.lit(1)).alias("prefix"), F.count_if(F.col("o_totalprice") > 1000).alias("retained"))
    return ingest.finished(p, 3, 1)


@query("""SELECT n_nationkey, list_distinct_sorted AS marks FROM (SELECT n_nationkey, array_to_string(list_sort(list_distinct(list_concat(range(0, CAST(n_nationkey AS BIGINT) + 1, 4), [CAST(n_nationkey AS BIGINT)]))), ',') AS list_distinct_sorted FROM nation)""")
def x10_checkpoints(spark, d):
    """When state is kept: 0, 4, 8, ... and the end."""
    return readers.table(spark, d, "nation").select("n_nationkey", F.array_join(V.checkpoints(F.col("n_nationkey"), 4).cast("array<string>"), ",").alias("marks"))

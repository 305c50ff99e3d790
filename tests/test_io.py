import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.sources import readers, writers
from quillmill.streaming import ingest


def record(generator, split="train"):
    texts = ["Changed.", "Initial answer.", "Changed.", "Changed but tie."]
    return {"split": split, "source_id": "s1", "source": "src", "generator": generator, "current": "Initial answer.", "candidates": [{"text": t, "finish_reason": "stop", "slot": i, "temperature": 0.5} for i, t in enumerate(texts)]}


def tables(store):
    occ = store.read("occurrences", ingest.OCCURRENCES)
    pairs = store.read("pairs", ingest.PAIRS)
    return occ.count(), pairs.count(), occ.where("noop").count(), sorted(r.n for r in occ.where("valid and not noop").groupBy("pair_id").agg(F.count("*").alias("n")).collect())


def test_batch_equals_increments_and_changes_are_errors(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "a.json").write_text(json.dumps(record("g1")))
    step = ingest.ingest_stream(spark, str(raw), str(tmp_path / "inc"), str(tmp_path / "cp"), 1)
    (raw / "b.json").write_text(json.dumps(record("g2")))
    step = ingest.ingest_stream(spark, str(raw), str(tmp_path / "inc"), str(tmp_path / "cp"), 1)
    whole = ingest.ingest_all(spark, str(raw), str(tmp_path / "all"))
    assert tables(step) == tables(whole) == (8, 2, 2, [2, 4])
    assert tables(ingest.ingest_all(spark, str(raw), str(tmp_path / "all"))) == (8, 2, 2, [2, 4])
    assert {r.status for r in ingest.integrity(whole, str(raw)).collect()} == {"ok"}
    (raw / "a.json").write_text(json.dumps(record("g3")))
    assert {r.status for r in ingest.integrity(whole, str(raw)).collect()} == {"ok", "changed"}
    with pytest.raises(Exception, match="changed since"):
        ingest.ingest_all(spark, str(raw), str(tmp_path / "all"))
    assert tables(whole) == (8, 2, 2, [2, 4])


def test_a_failed_batch_commits_nothing(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "a.json").write_text(json.dumps(record("g1")))
    (raw / "b.json").write_text("{broken")
    with pytest.raises(ValueError):
        ingest.ingest_all(spark, str(raw), str(tmp_path / "t"))
    (raw / "b.json").write_text(json.dumps(record("g2")))
    assert tables(ingest.ingest_all(spark, str(raw), str(tmp_path / "t"))) == (8, 2, 2, [2, 4])


def test_a_batch_never_sees_itself(spark, tmp_path):
    items = spark.range(5).withColumnRenamed("id", "item")
    seen = []

    def step(batch, library):
        seen.append(library.count())
        return batch.select(F.concat(F.lit("u"), "item").alias("unit"), F.col("batch").alias("birth_batch"))

    store = ingest.Store(spark, str(tmp_path / "lib"))
    out = ingest.micro_batches(items, "item", 2, spark.createDataFrame([("u0", -1)], "unit string, birth_batch long"), step, store, "unit string, birth_batch long")
    assert seen == [1, 3, 5] and out.count() == 6


SCHEMA = T.StructType([T.StructField("sample_id", T.StringType()), T.StructField("rounds", T.ArrayType(T.IntegerType()))])


def test_json_lines_of_all_kinds(spark, tmp_path):
    f = tmp_path / "x.jsonl"
    f.write_bytes('﻿{"sample_id": "a", "rounds": [1]}\n\n{bad}\n{"sample_id": "b", "rounds": [2]}\n{"sample_id": "c", "rou'.encode())
    got = readers.json_lines(spark, str(f), SCHEMA).orderBy("line_no").collect()
    assert [(r.line_no, r.status) for r in got] == [(1, "ok"), (2, "blank"), (3, "bad"), (4, "ok"), (5, "truncated")]
    with pytest.raises(Exception, match="line 3"):
        readers.require_ok(readers.json_lines(spark, str(f), SCHEMA)).collect()
    g = tmp_path / "n.jsonl"
    g.write_bytes(b'{"sample_id": "a\0", "rounds": [1]}\n{"sample_id": "b", "rounds": []}\n')
    assert [(r.row.sample_id, r.repaired) for r in readers.nul_repaired(spark, str(g), SCHEMA).orderBy("line_no").collect()] == [("a", True), ("b", False)]
    assert readers.json_tolerant(spark, str(f), SCHEMA, "rounds").where("bad").count() >= 2


def test_lines_of_files_in_many_splits(spark, tmp_path):
    files = {}
    for name, mark, end in (("a", b"", b"\n"), ("b", b"", b""), ("c", "\ufeff".encode(), b"\n"), ("d", "\ufeff".encode(), b""), ("e", b"", b"\r\n")):
        files[name] = [json.dumps({"sample_id": "é" * (i % 7) + str(i), "rounds": []}, ensure_ascii=False) for i in range(60)]
        (tmp_path / f"{name}.jsonl").write_bytes(mark + "\n".join(files[name]).encode() + end)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        got = readers.numbered_lines(spark, str(tmp_path / "*.jsonl"))
        assert spark.read.text(str(tmp_path / "*.jsonl")).rdd.getNumPartitions() > 5
        found = {}
        for r in got.orderBy("path", "line_no").collect():
            found.setdefault(r.path[-7], []).append((r.line_no, r.line.lstrip("\ufeff").rstrip("\r"), r.open))
        assert found == {name: [(k + 1, line, k == 59 and name in "bd") for k, line in enumerate(lines)] for name, lines in files.items()}
        assert readers.json_lines(spark, str(tmp_path / "*.jsonl"), SCHEMA, drop_last=True).groupBy("status").count().orderBy("status").collect() == [("ok", 298), ("truncated", 2)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_csv_with_byte_order_mark(spark, tmp_path):
    f = tmp_path / "x.csv"
    f.write_bytes('﻿source,gold\n" a ","line\nbreak"\nsame,same\n,x\n'.encode())
    df = readers.csv(spark, str(f))
    assert df.columns == ["source", "gold"]
    rows, counts = readers.contrastive(readers.coalesced(df, {"wrong": ["draft", "source"]}), ["wrong", "gold"], "wrong", "gold")
    assert [r.gold for r in rows.collect()] == ["line\nbreak"]
    assert tuple(counts.first()) == (1, 1, 3)


def test_discovery_and_manifests(spark, tmp_path):
    d = tmp_path / "runs" / "armA__t1"
    d.mkdir(parents=True)
    (d / "r.jsonl").write_text("\n".join(json.dumps({"task": "gigaword", "model": "m", "sample_id": str(i)}) for i in range(3)))
    schema = T.StructType([T.StructField(x, T.StringType()) for x in ("task", "model", "sample_id")])
    runs = readers.discover(spark, str(tmp_path / "runs" / "*" / "*.jsonl"), schema)
    r = runs.first()
    assert (r.arm, r.tag, r.n, r.consistent) == ("armA", "t1", 3, True)
    assert readers.complete(runs, {"gigaword": 4}).count() == 0
    assert readers.listed(spark, runs.select("path"), schema).count() == 3
    df = spark.createDataFrame([(2, "b"), (1, "a")], "i int, t string")
    n, digest = writers.write_manifest(df, str(tmp_path / "m"), "i")
    assert n == 2 and digest == str(writers.content_hash(df.repartition(3)).first()[1])
    with pytest.raises(Exception, match="(?i)exists"):
        writers.write_manifest(df, str(tmp_path / "m"), "i")
    writers.publish(spark, str(tmp_path / "m"), str(tmp_path / "public" / "m"))
    with pytest.raises(FileExistsError):
        writers.publish(spark, str(tmp_path / "public" / "m"), str(tmp_path / "public" / "m"))
    with pytest.raises(PermissionError):
        writers.refuse_sealed("/data/test/x")


def test_sinks(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "i int, a string"), spark.createDataFrame([(2, "y")], "i int, b string")
    writers.write_csv([a, b], str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).columns == ["i", "a", "b"]
    pairs = spark.createDataFrame([(i, "s", f"p{i}", f"q{i}", "armP", "armQ") for i in range(20)], "id int, source string, first string, second string, first_arm string, second_arm string")
    writers.review_package(pairs, str(tmp_path / "review"), "salt")
    sheet, key = spark.read.csv(str(tmp_path / "review/sheet"), header=True), spark.read.json(str(tmp_path / "review/key"))
    assert "arm" not in " ".join(sheet.columns) and {r.arm_of_a for r in key.collect()} == {"armP", "armQ"}
    parts = readers.with_global_index({"x": a, "y": a}, "i")
    assert sorted(r.global_index for r in parts.collect()) == [0, 1]
    assert readers.file_inventory(spark, str(tmp_path / "c"), "*.csv").count() >= 1

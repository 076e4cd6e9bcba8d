"""Streams against their batch twins, and file sources and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from docfoundry.operators import metadata, points
from docfoundry.plans import streams
from docfoundry.plans.documents import SCHEMA
from docfoundry.plans.registry import Tables
from docfoundry.sources import files
from docfoundry.streaming import events as ev

SF = "/root/testdata/sf0.001"


def test_job_state_stream_is_its_batch_twin(spark, tmp_path):
    t = Tables(spark, SF)
    batch = streams.attached(t)
    want = {r["document_id"]: tuple(r) for r in ev.job_state(batch).collect()}
    source = str(tmp_path / "in")
    # events arrive in order, a third of them at a time
    raw = streams.raw(t).orderBy("ts").coalesce(1)
    n = raw.count()
    ordered = raw.withColumn("part", F.floor(F.monotonically_increasing_id() * 3 / n)).cache()
    for k in range(4):
        ordered.filter(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("data string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    tasks = t.events.select("user_id").distinct().filter("user_id % 5 <> 0").select(F.col("user_id").cast("string").alias("task_id"), F.col("user_id").alias("document_id"))
    state = ev.job_state_stream(ev.attach_document(ev.parse_events(stream).filter("is_valid"), tasks))
    q = state.writeStream.outputMode("update").foreachBatch(lambda df, i: df.withColumn("i", F.lit(i)).write.mode("append").parquet(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    out = spark.read.parquet(str(tmp_path / "out"))
    last = out.groupBy("document_id").agg(F.max_by(F.struct("status", "is_ocred", "n_events"), "i").alias("s")).collect()
    assert {r["document_id"]: (r["document_id"], *r["s"]) for r in last} == want


def test_job_state_gathers_no_events(spark):
    import random

    r = random.Random(5)
    rows = [(1 if i % 3 == 0 else r.randrange(2, 60), r.randrange(300), i, r.choice(["Started", "Processing", "Processing", "Other", "GetMarkdown", "Failed"] if i % 4 == 0 else ["Started", "Processing"])) for i in range(3000)]
    rows += [(70, 5, 9000, "Failed")] * 2 + [(71, 1, 9001, "Started"), (None, 1, 9002, "Started")]
    want = {}
    for d, _, _, kind in sorted((x for x in rows if x[0]), key=lambda x: x[:3]):
        status, n = want.get(d, (None, 0))
        if kind in ev.STATUS and status not in ev.FINAL:
            want[d] = (ev.STATUS[kind], n + 1)
    got = ev.job_state(spark.createDataFrame(rows, "document_id long, ts int, event_id long, event_type string"))
    assert {x["document_id"]: (x["status"], x["n_events"]) for x in got.collect()} == want
    assert all(x["is_ocred"] == (x["status"] == "Succeeded") for x in got.collect())
    assert "collect_list" not in got._jdf.queryExecution().toString()


def test_logs_are_written_again_alike(spark, tmp_path):
    rows = [(1, 10, "SaveLog", '[{"message":"a","processingTime":1.0}]', "2024-01-01 00:00:00"), (2, 10, "SaveLog", "[]", "2024-01-01 00:00:01")]
    e = spark.createDataFrame(rows, "event_id long, document_id long, event_type string, data string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    for _ in range(2):
        ev.upsert_logs(e, 3, str(tmp_path / "logs"))
    got = spark.read.parquet(str(tmp_path / "logs")).collect()
    assert [(r["document_id"], [x["message"] for x in r["logs"]]) for r in got] == [(10, ["a"])]
    with pytest.raises(ValueError):
        ev.persisted_history(e, "other")


def test_pages_objects_and_points(spark, tmp_path):
    (tmp_path / "ocr").mkdir()
    (tmp_path / "ocr" / "a.json").write_text(json.dumps([{"page_index": 0, "markdown": "x", "images": {"k.jpg": "eA=="}}, {"page_index": 1, "markdown": "y", "images": {}}]))
    pages = files.read_ocr_pages(spark, str(tmp_path / "ocr")).withColumnRenamed("path", "doc_id")
    assert files.assemble_document(pages).first()["text"] == "x\nPage 1\n\n---\ny\nPage 2\n\n---\n"
    objects = files.list_objects(spark, str(tmp_path / "ocr")).collect()
    assert len(objects) == 1 and objects[0]["key"].endswith("a.json") and objects[0]["size"] > 0
    p = spark.createDataFrame([("p1", 1, "x"), ("p2", 2, "y")], "point_id string, dataset_id int, content string")
    points.write_points(p, str(tmp_path / "points"))
    points.write_points(p.filter("dataset_id = 2").withColumn("content", F.lit("z")), str(tmp_path / "points"))
    got = {r["point_id"]: r["content"] for r in spark.read.parquet(str(tmp_path / "points")).collect()}
    assert got == {"p1": "x", "p2": "z"}
    assert points.point_collisions(p.union(p.limit(1))).count() == 1
    assert set(files.load_tables(spark, SF, ["region", "nation"])) == {"region", "nation"}


def test_template_rules():
    t = metadata.Template.of(SCHEMA)
    good = {"kind": "Report", "year": 1, "note": "a"}
    assert t.errors(good) == [] and t.errors({**good, "x": 1}) == ["x: unknown"] and t.errors({"kind": "Report"}) == ["year: required", "note: required"]
    assert t.errors({**good, "note": "n" * 13}) == ["note: invalid"] and t.errors({**good, "when": "2020-1-1"}) == ["when: invalid"] and t.errors({**good, "when": None}) == []
    assert t.flat({"year": "7", "ok": "True", "amount": "2.5", "note": None, "tags": [], "who": {"name": "A"}}) == {"year": 7, "ok": True, "amount": 2.5, "who.name": "A"}

"""Streams with state against their batch twins, and replacement in storage."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from docfoundry.operators import points
from docfoundry.sources import versions
from docfoundry.streaming import events as ev
from docfoundry.streaming import state

EPOCH = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
EVENT = "document_id long, event_type string, event_id long, ts timestamp, data string"


def made(seed, n=1500, documents=40, minutes=6000):
    r = random.Random(seed)
    kinds = ["Started", "Processing", "Processing", "Other", "GetMarkdown", "Failed", "Canceled"]
    rows = [(r.randrange(documents), r.choice(kinds if i % 9 == 0 else kinds[:4]), i, EPOCH + dt.timedelta(minutes=r.randrange(minutes)), f"text {i}") for i in range(n)]
    return rows + [(None, "Started", n, EPOCH, "x"), (7, None, n + 1, EPOCH, "x")]


def written(spark, rows, folder, files, key):
    """The rows as Parquet files, dealt by key; file k is the older the smaller k is."""
    for k in range(files):
        part = [r for r in rows if key(r) == k]
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(str(folder))
    names = sorted((f for f in os.listdir(folder) if f.endswith(".parquet")), key=lambda f: os.path.getmtime(f"{folder}/{f}"))
    for k, f in enumerate(names):
        os.utime(f"{folder}/{f}", (1e9 + k * 60, 1e9 + k * 60))
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(stream, folder, each=None):
    """Run a stream over all there is; each micro-batch's rows are written with its number, or handed to `each`."""
    sink = each or (lambda df, i: df.withColumn("i", F.lit(i)).write.mode("append").parquet(f"{folder}/out"))
    q = stream.writeStream.outputMode("update" if each is None else "append").foreachBatch(sink).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return q


def last_rows(spark, folder):
    out = spark.read.parquet(f"{folder}/out")
    return out.groupBy("document_id").agg(F.max_by(F.struct("status", "is_ocred", "n_events", "data"), "i").alias("s")).select("document_id", "s.*")


def test_jobs_from_events_in_any_order_are_the_batch_twin(spark, tmp_path):
    rows = made(3)
    stream = written(spark, rows, tmp_path / "in", 5, lambda r: r[2] * 7919 % 5)
    run(state.job_states(stream, "30 days", "60 days"), tmp_path)
    want = {r["document_id"]: tuple(r) for r in ev.job_state(spark.createDataFrame(rows, EVENT)).collect()}
    last = last_rows(spark, tmp_path)
    assert {r["document_id"]: tuple(r)[:4] for r in last.collect()} == want
    # the same rows replace contents and clear summaries
    docs = spark.createDataFrame([(i, "Uploaded", False, f"old {i}", "s", "q", 1) for i in range(45)], "id long, status string, is_ocred boolean, ocr_content string, summary string, qa_summary string, job int")
    got = state.apply_job_states(docs, last)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ev.apply_results(docs, spark.createDataFrame(rows, EVENT)).select(docs.columns).collect()))


def test_jobs_settle_behind_the_watermark_and_go_when_idle(spark, tmp_path):
    # files in order of time but shuffled within: every event comes within the delay, and state is settled on the way
    rows = [r for r in made(4, minutes=60_000) if r[0] is not None]
    step = 60_000 / 6
    at = lambda r: (r[3] - EPOCH).total_seconds() / 60
    stream = written(spark, rows, tmp_path / "in", 6, lambda r: min(5, int(at(r) // step)))
    run(state.job_states(stream, "8 days", "300 days"), tmp_path)
    want = {r["document_id"]: tuple(r) for r in ev.job_state(spark.createDataFrame(rows, EVENT)).collect()}
    assert {r["document_id"]: tuple(r)[:4] for r in last_rows(spark, tmp_path).collect()} == want
    held = spark.read.format("statestore").option("path", f"{tmp_path}/cp").option("stateVarName", "waiting").option("flattenCollectionTypes", "true").load()
    assert held.count() < len(rows) / 3  # settled events aren't held one by one
    # a document that has been silent for long begins anew
    again = tmp_path / "again"
    old = [(1, "GetMarkdown", 1, EPOCH, "a"), (2, "Started", 2, EPOCH, "a")]
    new = [(9, "Started", 3, EPOCH + dt.timedelta(days=90), "b"), (9, "Started", 4, EPOCH + dt.timedelta(days=91), "b"), (1, "Started", 5, EPOCH + dt.timedelta(days=92), "c")]
    stream = written(spark, old + new, again / "in", 5, lambda r: r[2] - 1)
    run(state.job_states(stream, "1 hour", "30 days"), again)
    assert {r["document_id"]: tuple(r)[1:4] for r in last_rows(spark, again).collect()} == {1: ("Processing", False, 1), 2: ("Processing", False, 1), 9: ("Processing", False, 2)}


def plain_history(rows, now, hold=60):
    """Histories at `now`, by walking through each."""
    by = {}
    for d, kind, i, at, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[3], r[2])):
        if at <= now:
            h = by.setdefault((d, kind), [])
            if h and at - h[-1][1] > dt.timedelta(minutes=hold):
                h.clear()
            h.append((i, at))
    return sorted((*k, i, n) for k, h in by.items() if now - h[-1][1] <= dt.timedelta(minutes=hold) for n, (i, _) in enumerate(h, 1))


def by_key(rows):
    return sorted((r["document_id"], r["event_type"], r["event_id"], r["place"]) for r in rows)


@pytest.mark.parametrize("minutes", [0, 30, 400, 900, 1500, 1561])
def test_live_histories_against_a_walk(spark, minutes):
    r = random.Random(5)
    rows = [(r.randrange(3), r.choice(["Started", "Other"]), i, EPOCH + dt.timedelta(minutes=r.randrange(1500), seconds=r.choice([0, 0, 30])), "") for i in range(200)]
    now = EPOCH + dt.timedelta(minutes=minutes)
    got = state.live_histories(spark.createDataFrame(rows, EVENT), F.lit(now)).collect()
    assert by_key(got) == plain_history(rows, now)


def test_histories_expire_with_the_watermark(spark, tmp_path):
    r = random.Random(6)
    rows = [(r.randrange(6), "Started", i, EPOCH + dt.timedelta(minutes=r.randrange(i // 4, i // 4 + 40)), "") for i in range(1200)]
    rows.sort(key=lambda x: x[2])
    sizes = []
    for k in range(4):  # each run adds files; state, and histories read from it, are those of all events so far
        some = [x for x in rows if x[2] // 300 == k] if k < 3 else [(99, "Started", 5000, EPOCH + dt.timedelta(days=3), ""), (99, "Started", 5001, EPOCH + dt.timedelta(days=3, minutes=1), "")]
        stream = written(spark, some, tmp_path / "in", 1, lambda x: 0)
        run(state.histories(stream, "45 minutes"), tmp_path, lambda df, i: df.write.mode("append").parquet(f"{tmp_path}/sent"))
        so_far = [x for x in rows if x[2] // 300 <= k] + (some if k == 3 else [])
        now = max(x[3] for x in so_far)
        held = state.read_histories(spark, f"{tmp_path}/cp")
        sizes.append(held.count())
        assert by_key(state.live_histories(held, F.lit(now)).collect()) == plain_history(so_far, now)
    assert spark.read.parquet(f"{tmp_path}/sent").count() == 900 + 2
    assert sizes[3] == 2 < min(sizes[:3])


def test_rejected_events_go_to_a_sink_of_their_own(spark, tmp_path):
    raw = [('{"eventId":1,"taskId":"a","eventType":"Started"}',), ("{broken",), ('{"task_id":"b","event_type":"Failed"}',), ('{"taskId":"a"}',), (None,)]
    df = ev.parse_events(spark.createDataFrame(raw, "data string").withColumn("ts", F.lit(EPOCH)))
    for i in (0, 1, 0):
        state.split_events(df, i, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s/valid")).count() == 4 and spark.read.parquet(str(tmp_path / "s/rejected")).count() == 6
    os.makedirs(tmp_path / "raw")
    for k in range(3):
        (tmp_path / f"raw/{k}.json").write_text("\n".join('{"data":"{\\"taskId\\":\\"t\\",\\"eventType\\":\\"Started\\",\\"eventId\\":%d}","ts":"2024-01-01T00:00:00Z"}' % i if i % 2 else '{"data":"x"}' for i in range(10)))
    for _ in range(2):  # the second run has nothing to do
        run(ev.parse_events(spark.readStream.schema("data string, ts timestamp").json(str(tmp_path / "raw"))), tmp_path, lambda b, i: state.split_events(b, i, str(tmp_path / "t")))
    assert spark.read.parquet(str(tmp_path / "t/valid")).count() == 15 and spark.read.parquet(str(tmp_path / "t/rejected")).count() == 15


# --- replacement in storage -----------------------------------------------------------------------------------------

POINT = "point_id string, document_id string, dataset_id long, content string"


def files_of(path):
    return {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet") and "version=" in d}


def test_points_are_replaced_and_other_files_stay(spark, tmp_path):
    path = str(tmp_path / "points")
    first = [(f"p{d}-{k}", f"d{d}", d % 4, "old") for d in range(60) for k in range(3)]
    assert points.read_points(spark, path) is None
    assert points.replace_points(spark.createDataFrame(first, POINT), path, 1)
    before = files_of(path)
    new = [("n1", "d1", 1, "new"), ("n5", "d5", 3, "moved"), ("n99", "d99", 1, "fresh")]
    assert points.replace_points(spark.createDataFrame(new, POINT), path, 2)
    want = sorted([r for r in first if r[1] not in ("d1", "d5")] + new)
    read = lambda: sorted(tuple(r[c] for c in ("point_id", "document_id", "dataset_id", "content")) for r in points.read_points(spark, path).collect())
    assert read() == want
    assert before <= files_of(path) and len(files_of(path)) - len(before) <= 4  # no more than the buckets of d1, d5, d99
    assert not points.replace_points(spark.createDataFrame([("x", "d2", 2, "again")], POINT), path, 2) and read() == want
    assert versions.vacuum(spark, path) == 0  # the version before the current one may still be read
    for v in (3, 4):
        points.replace_points(spark.createDataFrame([("n1", "d1", 1, f"v{v}")], POINT), path, v)
    assert versions.vacuum(spark, path) > 0 and versions.vacuum(spark, path) == 0
    assert read() == sorted([r for r in want if r[1] != "d1"] + [("n1", "d1", 1, "v4")])


def test_a_killed_writer_leaves_one_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "points")
    points.replace_points(spark.createDataFrame([("a", "d1", 1, "old"), ("b", "d2", 1, "old"), ("c", "d3", 2, "old")], POINT), path, 1)
    commit = versions._commit
    monkeypatch.setattr(versions, "_commit", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        points.replace_points(spark.createDataFrame([("a2", "d1", 2, "half"), ("c2", "d3", 2, "half")], POINT), path, 2)
    seen = lambda: sorted((r["point_id"], r["content"]) for r in points.read_points(spark, path).collect())
    assert seen() == [("a", "old"), ("b", "old"), ("c", "old")]
    monkeypatch.setattr(versions, "_commit", commit)
    assert points.replace_points(spark.createDataFrame([("a3", "d1", 1, "new")], POINT), path, 2)
    assert seen() == [("a3", "new"), ("b", "old"), ("c", "old")]


def test_logs_of_later_batches_win_by_time(spark, tmp_path):
    at = lambda m: EPOCH + dt.timedelta(minutes=m)
    log = lambda m: f'[{{"message":"{m}","processingTime":1.0}}]'
    batches = [[(1, "SaveLog", 1, at(5), log("late")), (2, "SaveLog", 2, at(1), log("b"))], [(1, "SaveLog", 3, at(2), log("early")), (2, "SaveLog", 4, at(9), "[]"), (3, "Started", 5, at(1), log("no"))], [(2, "SaveLog", 6, at(4), log("c"))]]
    path = str(tmp_path / "logs")
    for i in (0, 1, 0, 2, 1):
        ev.upsert_logs(spark.createDataFrame(batches[i], EVENT), i, path)
    assert sorted((r["document_id"], [x["message"] for x in r["logs"]]) for r in ev.read_logs(spark, path).collect()) == [(1, ["late"]), (2, ["c"])]
    assert versions.vacuum(spark, path) >= 0 and ev.read_logs(spark, path).count() == 2


def test_a_merge_computes_its_rows_once(spark, tmp_path):
    from docfoundry.sources import versions

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = lambda n: spark.range(n).selectExpr("id as document_id", "id % 2 as bucket").mapInPandas(counted, "document_id long, bucket long")
    for version, n in ((0, 10), (1, 6)):  # as micro-batches of a stateful operator, which would run again
        versions.merge(rows(n), str(tmp_path / "m"), ["bucket"], "document_id", version)
    assert seen.value == 16 and versions.read_current(spark, str(tmp_path / "m")).count() == 10


def test_streamed_files_grow_in_number(spark, tmp_path):
    from types import SimpleNamespace

    from docfoundry.plans import streams

    rows = spark.range(5000).selectExpr("cast(id as string) as data", "timestamp'2024-01-01' as ts")
    batches = []
    streams.through(None, streams.dealt(SimpleNamespace(spark=spark), rows, str(tmp_path)), str(tmp_path), lambda b, i: batches.append(b.count()))
    assert len(list((tmp_path / "in").glob("*.json"))) == 2 * 8 and len([n for n in batches if n]) == 2 and sum(batches) == 5000


def test_histories_take_rows_one_by_one():
    from types import SimpleNamespace

    from pyspark.sql import Row

    held, timers = [], []
    entries = SimpleNamespace(exists=lambda: bool(held), get=lambda: iter(held), put=lambda x: held.__setitem__(slice(None), x), clear=held.clear)
    h = state.History(1000)
    h.init(SimpleNamespace(getListState=lambda *_: entries, registerTimer=timers.append))
    now = SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    out = [r for batch in ([Row(at=5_000, event_id=2)], [Row(at=3_000, event_id=1)]) for r in h.handleInputRows((7, "a"), iter(batch), now)]
    assert [(r["document_id"], r["event_type"], r["event_id"], r["at"]) for r in out] == [(7, "a", 2, 5_000), (7, "a", 1, 3_000)]
    assert held == [(3_000, 1), (5_000, 2)] and timers == [1006, 1006]

"""Queries of the event stream, on its batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from docfoundry.operators.questions import progress_report
from docfoundry.sources.versions import merge, read_current
from docfoundry.streaming import events as ev
from docfoundry.streaming import state

from .registry import query

_TYPE = "CASE event_type WHEN 'signup' THEN 'Started' WHEN 'purchase' THEN 'GetMarkdown' WHEN 'error' THEN 'Failed' ELSE 'Processing' END"
_E = f"e AS (SELECT event_id, ts, user_id, CAST(user_id AS STRING) AS task_id, {_TYPE} AS type, value, 'page ' || (event_id % 7) || '/7' AS message FROM events WHERE event_id % 41 <> 0)"


def raw(t):
    """(data, ts): events as JSON; every 41st row is broken, every 37th has its keys in the other style."""
    task, kind = F.col("user_id").cast("string"), F.expr(_TYPE)
    rest = [F.col("event_id").alias("eventId"), F.concat(F.lit("page "), (F.col("event_id") % 7).cast("string"), F.lit("/7")).alias("message"), F.col("value").alias("processingTime"), F.lit("s").alias("status")]
    one = F.to_json(F.struct(task.alias("taskId"), kind.alias("eventType"), *rest))
    two = F.to_json(F.struct(task.alias("task_id"), kind.alias("event_type"), *rest))
    return t.events.select(F.when(F.col("event_id") % 41 == 0, "{broken").when(F.col("event_id") % 37 == 0, two).otherwise(one).alias("data"), "ts")


def valid(t):
    return ev.parse_events(raw(t)).filter("is_valid")


def attached(t):
    tasks = t.events.select("user_id").distinct().filter("user_id % 5 <> 0").select(F.col("user_id").cast("string").alias("task_id"), F.col("user_id").alias("document_id"))
    return ev.attach_document(valid(t), tasks)


@query("i1_parse_events", f"WITH {_E} SELECT true AS is_valid, event_id, task_id, type AS event_type, message FROM e UNION ALL SELECT false, NULL, NULL, NULL, NULL FROM events WHERE event_id % 41 = 0")
def _(t):
    return ev.parse_events(raw(t)).select("is_valid", "event_id", "task_id", "event_type", "message")


@query("i2_attach_document", f"WITH {_E} SELECT event_id, CASE WHEN user_id % 5 <> 0 THEN user_id END AS document_id FROM e")
def _(t):
    return attached(t).select("event_id", "document_id")


@query("i2_count_unmatched", f"WITH {_E} SELECT type AS event_type, count(*) AS n_events, count(*) FILTER (user_id % 5 = 0) AS n_dropped FROM e GROUP BY 1")
def _(t):
    return ev.count_unmatched(attached(t))


@query("i3_apply_results", f"""WITH {_E}, f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM e WHERE user_id % 5 <> 0), x AS (SELECT user_id, min(n) FILTER (type IN ('GetMarkdown', 'Failed')) AS z, max(n) AS m FROM f GROUP BY 1),
 s AS (SELECT f.user_id, CASE type WHEN 'GetMarkdown' THEN 'Succeeded' WHEN 'Failed' THEN 'Failed' ELSE 'Processing' END AS to_status, 'text of ' || event_id AS body FROM f JOIN x ON x.user_id = f.user_id AND f.n = coalesce(x.z, x.m))
 SELECT d.id, coalesce(to_status, d.status) AS status, is_ocred OR coalesce(to_status = 'Succeeded', false) AS is_ocred, CASE WHEN to_status = 'Succeeded' THEN body ELSE ocr_content END AS ocr_content, CASE WHEN to_status = 'Succeeded' THEN NULL ELSE summary END AS summary,
 CASE WHEN to_status = 'Succeeded' THEN NULL ELSE qa_summary END AS qa_summary FROM document d LEFT JOIN s ON s.user_id = d.id""", "document")  # fmt: skip
def _(t):
    events = attached(t).withColumn("data", F.concat(F.lit("text of "), F.col("event_id").cast("string")))
    return ev.apply_results(t.document, events).select("id", "status", "is_ocred", "ocr_content", "summary", "qa_summary")


@query("i3_job_state", f"""WITH {_E}, f AS (SELECT *, row_number() OVER w AS n, count(*) FILTER (type IN ('GetMarkdown', 'Failed')) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM e WHERE user_id % 5 <> 0 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
 SELECT user_id AS document_id, CASE arg_max(type, n) WHEN 'GetMarkdown' THEN 'Succeeded' WHEN 'Failed' THEN 'Failed' ELSE 'Processing' END AS status, arg_max(type, n) = 'GetMarkdown' AS is_ocred, CAST(count(*) AS INT) AS n_events FROM f WHERE ended = 0 GROUP BY 1""")  # fmt: skip
def _(t):
    return ev.job_state(attached(t))


@query("i4_save_logs", f"WITH {_E} SELECT user_id AS document_id, CAST(arg_max(event_id, (ts, event_id)) AS STRING) AS last FROM e WHERE event_id % 3 = 0 AND user_id % 5 <> 0 GROUP BY 1")
def _(t):
    logs = F.to_json(F.array(F.struct(F.col("event_id").cast("string").alias("message"), F.lit(1.0).alias("processingTime"))))
    e = attached(t).filter("document_id is not null").withColumns({"event_type": F.lit("SaveLog"), "data": F.when(F.col("event_id") % 3 == 0, logs).otherwise("[]")})
    return ev.save_logs(e).select("document_id", F.col("logs")[0]["message"].alias("last"))


@query("i5_notifications", f"WITH {_E} SELECT user_id AS document_id, event_id, CASE type WHEN 'GetMarkdown' THEN 'Succeeded' WHEN 'Failed' THEN 'Failed' ELSE 'Processing' END AS status, message FROM e WHERE user_id % 5 <> 0")
def _(t):
    return ev.notifications(attached(t))


@query("i6_notification_history", f"""WITH {_E}, m AS (SELECT max(ts) AS now FROM e), h AS (SELECT *, max(ts) OVER (PARTITION BY user_id, type) AS last, row_number() OVER (PARTITION BY user_id, type ORDER BY ts, event_id) AS place FROM e WHERE user_id % 5 <> 0)
 SELECT user_id AS document_id, type AS event_type, event_id, CAST(place AS INT) AS place FROM h, m WHERE last >= now - INTERVAL 1 HOUR""")  # fmt: skip
def _(t):
    e = attached(t)
    now = e.agg(F.max("ts").alias("now"))
    return ev.notification_history(e.join(now, F.lit(True)), F.col("now"))


@query("i7_persisted_history", "SELECT user_id AS document_id, CAST(i AS INT) AS place, 'm' || i AS message FROM (SELECT user_id, unnest(range(0, user_id % 4)) AS i FROM (SELECT DISTINCT user_id FROM events) u) x")
def _(t):
    logs = t.events.select("user_id").distinct().filter("user_id % 4 > 0").select(F.col("user_id").alias("document_id"), F.transform(F.sequence(F.lit(0).cast("long"), F.col("user_id") % 4 - 1), lambda i: F.struct(F.concat(F.lit("m"), i.cast("string")).alias("message"), F.lit(1.0).alias("processingTime"))).alias("logs"))
    return ev.persisted_history(logs, "ocr").select("document_id", "place", "message")


@query("e11_latest_status", f"WITH {_E} SELECT task_id, arg_max(type, event_id) AS event_type, arg_max(message, event_id) AS message FROM (SELECT * FROM e WHERE (user_id, ts) IN (SELECT (user_id, max(ts)) FROM e GROUP BY user_id)) x GROUP BY 1")
def _(t):
    return ev.latest_status(valid(t))


@query("f11_retain_last", f"WITH {_E} SELECT event_id FROM e ORDER BY ts DESC, event_id DESC LIMIT 1000")
def _(t):
    return ev.retain_last(valid(t)).select("event_id")


@query("d14_progress_report", f"""WITH {_E}, l AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ts DESC, event_id DESC) AS n FROM e)
 SELECT task_id, max(CASE WHEN n = 1 THEN 's' END) AS status, CAST(max(CASE WHEN n = 1 THEN event_id % 7 END) AS INT) AS done, 7 AS total, round(sum(value), 2) AS seconds FROM l GROUP BY 1""")  # fmt: skip
def _(t):
    return progress_report(valid(t)).withColumn("seconds", F.round("seconds", 2))


@query("a10_read_ocr_events", f"WITH {_E} SELECT true AS is_valid, event_id, task_id, type AS event_type FROM e UNION ALL SELECT false, NULL, NULL, NULL FROM events WHERE event_id % 41 = 0")
def _(t):
    """The events as files, read as a stream, parsed, and written by it."""
    from docfoundry.sources.files import read_ocr_events, scratch_folder

    folder = scratch_folder(t.spark, "events")
    raw(t).write.json(f"{folder}/in")
    found = ev.parse_events(read_ocr_events(t.spark, f"{folder}/in")).select("is_valid", "event_id", "task_id", "event_type")
    found.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return t.spark.read.parquet(f"{folder}/out")


@query("i4_upsert_logs", f"WITH {_E} SELECT user_id AS document_id, CAST(arg_max(event_id, (ts, event_id)) AS STRING) AS last FROM e WHERE event_id % 3 = 0 AND user_id % 5 <> 0 GROUP BY 1")
def _(t):
    """The log lists in two batches, the later events first, and the first batch once more."""
    from docfoundry.sources.files import scratch_folder

    folder = scratch_folder(t.spark, "logs")
    logs = F.to_json(F.array(F.struct(F.col("event_id").cast("string").alias("message"), F.lit(1.0).alias("processingTime"))))
    e = attached(t).filter("document_id is not null").withColumns({"event_type": F.lit("SaveLog"), "data": F.when(F.col("event_id") % 3 == 0, logs).otherwise("[]")})
    for batch, rest in ((0, 1), (1, 0), (0, 1)):
        ev.upsert_logs(e.filter(F.col("event_id") % 2 == rest), batch, folder)
    return ev.read_logs(t.spark, folder).select("document_id", F.col("logs")[0]["message"].alias("last"))


def dealt(t, rows, folder, batches=2):
    """The rows as a stream of JSON files, dealt out of order, in so many micro-batches; files grow in number, not in size, with the input."""
    n = batches * int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(n, F.xxhash64("data")).write.json(f"{folder}/in")
    return t.spark.readStream.schema("data string, ts timestamp").option("maxFilesPerTrigger", n // batches).json(f"{folder}/in")


def through(t, stream, folder, each, mode="append"):
    """Run a stream over all there is, each micro-batch into a foreachBatch sink."""
    stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()


def tasks(t):
    return t.events.select("user_id").distinct().filter("user_id % 5 <> 0").select(F.col("user_id").cast("string").alias("task_id"), F.col("user_id").alias("document_id"))


@query("i1_reject_sink", f"WITH {_E} SELECT 'valid' AS sink, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM e UNION ALL SELECT 'rejected', count(*), NULL FROM events WHERE event_id % 41 = 0")
def _(t):
    """One stream, two sinks; the first batch comes again."""
    from docfoundry.sources.files import scratch_folder

    folder = scratch_folder(t.spark, "split")
    stream = ev.parse_events(dealt(t, raw(t), folder))

    def split(batch, i):
        for _ in range(2 if i == 0 else 1):
            state.split_events(batch, i, f"{folder}/out")

    through(t, stream, folder, split)
    counts = [t.spark.read.parquet(f"{folder}/out/{sink}").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids")).select(F.lit(sink).alias("sink"), "n", "ids") for sink in ("valid", "rejected")]
    return counts[0].union(counts[1])


@query("i3_job_state_stream", f"""WITH {_E}, f AS (SELECT *, row_number() OVER w AS n, count(*) FILTER (type IN ('GetMarkdown', 'Failed')) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM e WHERE user_id % 5 <> 0 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
 SELECT user_id AS document_id, CASE arg_max(type, n) WHEN 'GetMarkdown' THEN 'Succeeded' WHEN 'Failed' THEN 'Failed' ELSE 'Processing' END AS status, arg_max(type, n) = 'GetMarkdown' AS is_ocred, CAST(count(*) AS INT) AS n_events FROM f WHERE ended = 0 GROUP BY 1""")  # fmt: skip
def _(t):
    """Events out of order over several micro-batches; the last row of each document is kept in storage."""
    from docfoundry.sources.files import scratch_folder

    folder = scratch_folder(t.spark, "jobs")
    stream = ev.attach_document(ev.parse_events(dealt(t, raw(t), folder)).filter("is_valid"), tasks(t))
    put = lambda batch, i: merge(batch.withColumn("bucket", F.pmod("document_id", F.lit(4)).cast("int")), f"{folder}/out", ["bucket"], "document_id", i)
    through(t, state.job_states(stream, "3650 days", "3650 days").drop("data"), folder, put, "update")
    return read_current(t.spark, f"{folder}/out").select("document_id", "status", "is_ocred", "n_events")


_LIVE = f"""{_E}, m AS (SELECT max(ts) AS now FROM e), g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 1 HOUR THEN 1 ELSE 0 END AS quiet FROM e WHERE user_id % 5 <> 0 WINDOW w AS (PARTITION BY user_id, type ORDER BY ts, event_id)),
 i AS (SELECT *, sum(quiet) OVER (PARTITION BY user_id, type ORDER BY ts, event_id) AS part FROM g), z AS (SELECT *, max(part) OVER (PARTITION BY user_id, type) AS last_part, max(ts) OVER (PARTITION BY user_id, type) AS last FROM i),
 live AS (SELECT user_id AS document_id, type AS event_type, event_id, CAST(row_number() OVER (PARTITION BY user_id, type ORDER BY ts, event_id) AS INT) AS place FROM z, m WHERE part = last_part AND last >= now - INTERVAL 1 HOUR)"""


@query("i6_live_history", f"WITH {_LIVE} SELECT * FROM live")
def _(t):
    """Histories as they stand after the last event: a silence of an hour ends one."""
    e = attached(t).filter("document_id is not null")
    now = valid(t).agg(F.max("ts")).first()[0]
    return state.live_histories(e, F.lit(now))


@query("i6_history_stream", f"WITH {_LIVE} SELECT * FROM live")
def _(t):
    """The same from the state of a stream."""
    from docfoundry.sources.files import scratch_folder

    folder = scratch_folder(t.spark, "history")
    stream = ev.attach_document(ev.parse_events(dealt(t, raw(t), folder)).filter("is_valid"), tasks(t))
    through(t, state.histories(stream, "3650 days"), folder, lambda batch, i: batch.write.format("noop").mode("overwrite").save())
    now = valid(t).agg(F.max("ts")).first()[0]
    return state.live_histories(state.read_histories(t.spark, f"{folder}/state"), F.lit(now))

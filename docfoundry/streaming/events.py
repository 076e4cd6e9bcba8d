"""The stream of processing events: parsing, job state, logs, notifications. Every function takes batches and streams alike,
save job_state_stream(), whose twin on batches is job_state()."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfoundry.sources.versions import merge, read_current

#: Event type to job status; the last three end a job.
STATUS = {"Started": "Processing", "Processing": "Processing", "GetMarkdown": "Succeeded", "Failed": "Failed", "Canceled": "Canceled"}
FINAL = ("Succeeded", "Failed", "Canceled")
SPREAD = 32
_EVENT = "struct<eventId:bigint,taskId:string,task_id:string,status:string,eventType:string,event_type:string,message:string,processingTime:double,dataJson:string,data_json:string,data:string>"


def parse_events(raw: DataFrame) -> DataFrame:
    """(event_id, ts, task_id, event_type, status, message, processing_time, data, is_valid) of JSON texts in `data`; keys come in either style.
    A row without a task or event type, or that isn't JSON, isn't valid."""
    e = F.from_json("data", _EVENT)
    read = raw.select("ts", e.alias("e")).select(
        F.col("e.eventId").alias("event_id"),
        "ts",
        F.coalesce("e.taskId", "e.task_id").alias("task_id"),
        F.coalesce("e.eventType", "e.event_type").alias("event_type"),
        F.col("e.status").alias("status"),
        F.col("e.message").alias("message"),
        F.col("e.processingTime").alias("processing_time"),
        F.coalesce("e.dataJson", "e.data_json", "e.data").alias("data"),
    )
    return read.withColumn("is_valid", F.col("task_id").isNotNull() & F.col("event_type").isNotNull())


def attach_document(events: DataFrame, tasks: DataFrame) -> DataFrame:
    """Events with their task's document_id, null for an unknown task: those are counted, then dropped."""
    return events.join(tasks.select("task_id", "document_id"), "task_id", "left")


def count_unmatched(attached: DataFrame) -> DataFrame:
    """(event_type, n_events, n_dropped) of attach_document()'s events: those of unknown tasks are dropped."""
    return attached.groupBy("event_type").agg(F.count("*").alias("n_events"), F.count_if(F.col("document_id").isNull()).alias("n_dropped"))


def _mapped():
    return F.create_map(*(F.lit(x) for kv in STATUS.items() for x in kv))


def attached_status(events: DataFrame) -> DataFrame:
    """Events of known documents that change a job, with the status that they change it `to`."""
    return events.withColumn("to", F.try_element_at(_mapped(), "event_type")).filter("to is not null and document_id is not null")


def job_state(events: DataFrame) -> DataFrame:
    """(document_id, status, is_ocred, n_events): events in order up to the first that ends the job; later ones are dropped.

    A document's events meet its end in SPREAD parts, and only counts are brought together: no group is unbounded.
    """
    seen = attached_status(events).select("document_id", F.struct("ts", "event_id", "to").alias("e"), F.pmod(F.xxhash64("event_id"), F.lit(SPREAD)).alias("_part"))
    ends = seen.groupBy("document_id").agg(F.min(F.when(F.col("e.to").isin(*FINAL), F.col("e"))).alias("first"), F.max("e").alias("last"), F.count("*").alias("all"))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SPREAD - 1).cast("bigint"))).alias("_part")
    stops = ends.filter("first is not null").select("document_id", "first", every)
    before = seen.join(stops, ["document_id", "_part"]).filter(F.col("e") < F.col("first")).groupBy("document_id").agg(F.count("*").alias("n"))
    found = ends.join(before, "document_id", "left").select("document_id", F.coalesce("first.to", "last.to").alias("status"), F.when(F.col("first").isNull(), F.col("all")).otherwise(F.coalesce("n", F.lit(0)) + 1).cast("int").alias("n_events"))
    return found.select("document_id", "status", (F.col("status") == "Succeeded").alias("is_ocred"), "n_events")


def apply_results(documents: DataFrame, events: DataFrame) -> DataFrame:
    """documents (id, status, is_ocred, ocr_content, summary, qa_summary, ..) after their events: a job's state becomes the status; where it
    succeeded, the text that came with the event that ended it replaces the content, and both summaries are cleared."""
    seen = events.withColumn("_to", F.try_element_at(_mapped(), "event_type")).filter("_to is not null and document_id is not null")
    order = F.struct("ts", "event_id")
    text = seen.filter(F.col("_to").isin(*FINAL)).groupBy("document_id").agg(F.min_by(F.struct(F.col("data").alias("text")), order).alias("_end"))
    state = job_state(events).select(F.col("document_id").alias("id"), F.col("status").alias("_status")).join(text.withColumnRenamed("document_id", "id"), "id", "left")
    done = F.coalesce(F.col("_status") == "Succeeded", F.lit(False))
    joined = documents.join(state, "id", "left")
    return joined.withColumns({
        "status": F.coalesce("_status", "status"),
        "is_ocred": done | F.col("is_ocred"),
        "ocr_content": F.when(done, F.col("_end.text")).otherwise(F.col("ocr_content")),
        "summary": F.when(~done, F.col("summary")),
        "qa_summary": F.when(~done, F.col("qa_summary")),
    }).drop("_status", "_end")


def job_state_stream(events: DataFrame, idle: str = "30 days", delay: str = "1 hour") -> DataFrame:
    """job_state() of a stream, as updates: state by document, dropped after `idle` without events; events come in any order in `delay`."""
    from .state import job_states

    return job_states(events, delay, idle).drop("data")


def latest_status(events: DataFrame) -> DataFrame:
    """(task_id, event_type, message) of the last event of each task."""
    order = F.struct("ts", "event_id")
    return events.groupBy("task_id").agg(F.max_by("event_type", order).alias("event_type"), F.max_by("message", order).alias("message"))


def save_logs(events: DataFrame) -> DataFrame:
    """(document_id, logs): the last list of logs that isn't empty replaces what there was."""
    logs = F.from_json("data", "array<struct<message:string,processingTime:double>>")
    found = events.filter("event_type = 'SaveLog'").withColumn("logs", logs).filter("size(logs) > 0")
    return found.groupBy("document_id").agg(F.max_by("logs", F.struct("ts", "event_id")).alias("logs"))


LOG_BUCKETS = 16


def upsert_logs(batch: DataFrame, batch_id: int, path: str, buckets: int = LOG_BUCKETS) -> None:
    """A foreachBatch sink: a document's last list of logs, by time, replaces the one it has in storage. Only buckets of documents in the
    batch are written; a batch that comes again, or whose writer was killed, leaves one version of them."""
    logs = F.from_json("data", "array<struct<message:string,processingTime:double>>")
    found = batch.filter("event_type = 'SaveLog' and document_id is not null").withColumn("logs", logs).filter("size(logs) > 0")
    bucket = F.pmod(F.xxhash64("document_id"), F.lit(buckets)).cast("int").alias("bucket")
    new = found.select("document_id", "logs", F.struct("ts", "event_id").alias("at"), bucket)
    last = lambda df: df.groupBy("document_id", "bucket").agg(F.max_by("logs", "at").alias("logs"), F.max("at").alias("at"))
    merge(last(new), path, ["bucket"], "document_id", batch_id, combine=lambda old, new: last(old.unionByName(new)))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, logs) of what upsert_logs() has written."""
    return read_current(spark, path).select("document_id", "logs")


def notifications(events: DataFrame) -> DataFrame:
    """(document_id, event_id, status, message) for each event that changes a job."""
    status = F.try_element_at(_mapped(), "event_type")
    return events.filter("document_id is not null").withColumn("to", status).filter("to is not null").select("document_id", "event_id", F.col("to").alias("status"), "message")


def notification_history(events: DataFrame, now) -> DataFrame:
    """(document_id, event_type, event_id, place): histories whose last message is an hour old at most, in order."""
    from pyspark.sql import Window

    w = Window.partitionBy("document_id", "event_type")
    kept = events.filter("document_id is not null").withColumn("last", F.max("ts").over(w)).filter(F.col("last") >= now - F.expr("interval 1 hour"))
    return kept.select("document_id", "event_type", "event_id", F.row_number().over(w.orderBy("ts", "event_id")).alias("place"))


def persisted_history(logs: DataFrame, kind: str) -> DataFrame:
    """(document_id, place, message, processing_time) of stored lists of a kind (ocr, indexing, qa)."""
    if kind not in ("ocr", "indexing", "qa"):
        raise ValueError(f"no such history: {kind}")
    return logs.select("document_id", F.posexplode("logs").alias("place", "l")).select("document_id", "place", F.col("l.message").alias("message"), F.col("l.processingTime").alias("processing_time"))


def retain_last(events: DataFrame, n: int = 1000) -> DataFrame:
    """The newest n events."""
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)

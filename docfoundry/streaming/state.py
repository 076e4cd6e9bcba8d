"""Streams with state: jobs of documents, and histories of notifications that expire. Keys keep their events in order of time, however these
are dealt to micro-batches; timers on the watermark settle what can't change any more and remove what is over."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from docfoundry.sources.files import held

from .events import FINAL, STATUS, attached_status

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """State variables and timers need this store; a session that has another one set keeps it."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "HDFSBacked" in spark.conf.get(key):
        spark.conf.set(key, ROCKSDB)


def _millis(text: str) -> int:
    return int(pd.Timedelta(text).total_seconds() * 1000)


class JobState(StatefulProcessor):
    """The job of one document.

    `settled` holds status, number of events, the time of the last one and the text that ended the job, of all events at or before the
    watermark, which no event can precede any more; `waiting` the events after it, in order, none after the first that ends the job.
    """

    WAITING = "at long, event_id long, to string, data string"
    SETTLED = "status string, n long, at long, data string"
    OUT = "document_id long, status string, is_ocred boolean, n_events int, data string"

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", self.SETTLED)
        self.waiting = handle.getListState("waiting", self.WAITING)

    def _settle(self, settled: tuple, waiting: list[tuple], watermark: int) -> tuple[tuple, list[tuple]]:
        past = sum(at // 1000 <= watermark for at, *_ in waiting)  # in order of time
        if past:
            at, _, to, data = waiting[past - 1]
            settled = (to, settled[1] + past, at, data if to in FINAL else None)
        return settled, waiting[past:]

    def _keep(self, settled: tuple, waiting: list[tuple]) -> None:
        """Write the state back, and wake up when the next event can be settled or the job has been idle for long."""
        self.settled.update(settled)
        if waiting:
            self.waiting.put(waiting)
            self.handle.registerTimer(waiting[0][0] // 1000 + 1)
        else:
            self.waiting.clear()
            self.handle.registerTimer(settled[2] // 1000 + self.idle)

    def _held(self) -> tuple[tuple, list[tuple]]:
        settled = tuple(self.settled.get()) if self.settled.exists() else (None, 0, 0, None)
        return settled, [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []

    def handleInputRows(self, key, rows, timerValues):
        settled, waiting = self._held()
        new = [(r["at"], r["event_id"], r["to"], r["data"]) for r in rows]
        if settled[0] in FINAL:
            return
        both = sorted([*waiting, *new], key=lambda x: x[:2])
        end = next((i for i, x in enumerate(both) if x[2] in FINAL), len(both))  # what comes after the first end never counts
        settled, waiting = self._settle(settled, both[: end + 1], timerValues.getCurrentWatermarkInMs())
        self._keep(settled, waiting)
        status, data = waiting[-1][2:] if waiting else (settled[0], settled[3])
        yield Row(document_id=key[0], status=status, is_ocred=status == "Succeeded", n_events=settled[1] + len(waiting), data=data if status in FINAL else None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        settled, waiting = self._held()
        settled, waiting = self._settle(settled, waiting, timerValues.getCurrentWatermarkInMs())
        if not waiting and settled[2] // 1000 + self.idle <= timerValues.getCurrentWatermarkInMs():
            self.settled.clear()
            self.waiting.clear()
        else:
            self._keep(settled, waiting)
        return iter(())

    def close(self) -> None:
        pass


def job_states(events: DataFrame, delay: str = "1 hour", idle: str = "30 days") -> DataFrame:
    """(document_id, status, is_ocred, n_events, data) of a stream of attached events, a row for each document that a micro-batch changes;
    a document's last row is what job_state() says of its events. data is the text of the event that ended the job.

    Events may come in any order within `delay`; later ones are dropped. A job's state goes `idle` after its last event; events after that
    begin a new one.
    """
    use_state_store(events.sparkSession)
    seen = attached_status(events).withWatermark("ts", delay)
    seen = seen.select("document_id", "ts", F.unix_micros("ts").alias("at"), "event_id", "to", F.when(F.col("to").isin(*FINAL), F.col("data")).alias("data"))
    return seen.groupBy("document_id").transformWithState(JobState(_millis(idle)), JobState.OUT, "Update", "EventTime")


def apply_job_states(documents: DataFrame, states: DataFrame) -> DataFrame:
    """documents (id, status, is_ocred, ocr_content, summary, qa_summary, ..) after rows of job_states(), one for each document at most: the
    status is the job's; where that succeeded, its text replaces the content, and both summaries are cleared."""
    s = states.select(F.col("document_id").alias("id"), F.struct(F.col("status").alias("to"), F.col("data").alias("text")).alias("job"))
    joined = documents.select("id", F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("d")).join(s, "id", "left")
    done, d = F.coalesce(F.col("job.to") == "Succeeded", F.lit(False)), "d"
    changed = {
        "status": F.coalesce("job.to", f"{d}.status"),
        "is_ocred": done | F.col(f"{d}.is_ocred"),
        "ocr_content": F.when(done, F.col("job.text")).otherwise(F.col(f"{d}.ocr_content")),
        "summary": F.when(~done, F.col(f"{d}.summary")),
        "qa_summary": F.when(~done, F.col(f"{d}.qa_summary")),
    }
    return joined.select(*(changed[c].alias(c) if c in changed else F.col(d)[c].alias(c) for c in documents.columns))


class History(StatefulProcessor):
    """The notifications of one document and type, until an hour has gone by without a further one."""

    ENTRY = "at long, event_id long"
    OUT = "document_id long, event_type string, event_id long, at long"

    def __init__(self, hold: int):
        self.hold = hold

    def init(self, handle) -> None:
        self.handle = handle
        self.entries = handle.getListState("entries", self.ENTRY)

    def _drop(self, entries: list[tuple[int, int]], watermark: int) -> list[tuple[int, int]]:
        """What is left once the silences that lie wholly before the watermark have ended the histories before them."""
        first = 0
        for i, (at, _) in enumerate(entries):
            after = entries[i + 1][0] if i + 1 < len(entries) else None
            if at // 1000 + self.hold < watermark and (after is None or after - at > self.hold * 1000):
                first = i + 1
        return entries[first:]

    def _keep(self, entries: list[tuple[int, int]]) -> None:
        if not entries:
            self.entries.clear()
            return
        self.entries.put(entries)
        end = next((at for i, (at, _) in enumerate(entries) if i + 1 == len(entries) or entries[i + 1][0] - at > self.hold * 1000))
        self.handle.registerTimer(end // 1000 + self.hold + 1)

    def handleInputRows(self, key, rows, timerValues):
        new = [(r["at"], r["event_id"]) for r in rows]
        held = [tuple(r) for r in self.entries.get()] if self.entries.exists() else []
        held = sorted([*held, *new])
        self._keep(self._drop(held, timerValues.getCurrentWatermarkInMs()))
        yield from (Row(document_id=key[0], event_type=key[1], event_id=i, at=at) for at, i in new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = [tuple(r) for r in self.entries.get()] if self.entries.exists() else []
        self._keep(self._drop(held, timerValues.getCurrentWatermarkInMs()))
        return iter(())

    def close(self) -> None:
        pass


def histories(events: DataFrame, delay: str = "10 minutes", hold: str = "1 hour") -> DataFrame:
    """(document_id, event_type, event_id, ts): the notifications as they come; the state of the query holds the live histories, which
    read_histories() reads. A history ends with `hold` of silence, as of the watermark, which runs `delay` behind the events."""
    use_state_store(events.sparkSession)
    seen = events.filter("document_id is not null").withWatermark("ts", delay).select("document_id", "event_type", "ts", F.unix_micros("ts").alias("at"), "event_id")
    found = seen.groupBy("document_id", "event_type").transformWithState(History(_millis(hold)), History.OUT, "Append", "EventTime")
    return found.select("document_id", "event_type", "event_id", F.timestamp_micros("at").alias("ts"))


def read_histories(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(document_id, event_type, event_id, ts) of what the state of a query over histories() holds after its last micro-batch."""
    use_state_store(spark)
    held = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "entries").option("flattenCollectionTypes", "true").load()
    return held.select("key.document_id", "key.event_type", "list_element.event_id", F.timestamp_micros("list_element.at").alias("ts"))


def live_histories(entries: DataFrame, now, hold: str = "1 hour") -> DataFrame:
    """(document_id, event_type, event_id, place) of entries (document_id, event_type, event_id, ts): histories as they are at `now`, in
    order. A silence of more than `hold` ends a history, so only what came after the last one counts, and nothing once `hold` is over."""
    from pyspark.sql import Window

    w = Window.partitionBy("document_id", "event_type").orderBy("ts", "event_id")
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    quiet = F.coalesce(micros(F.col("ts")) - micros(F.lag("ts").over(w)) > _millis(hold) * 1000, F.lit(False))
    parts = entries.filter(F.col("ts") <= now).withColumn("part", F.sum(quiet.cast("int")).over(w))
    ends = parts.groupBy("document_id", "event_type").agg(F.max("part").alias("part"), F.max("ts").alias("last"))
    live = parts.join(ends.filter(micros(F.col("last")) + _millis(hold) * 1000 >= micros(now)).drop("last"), ["document_id", "event_type", "part"], "left_semi")
    return live.select("document_id", "event_type", "event_id", F.row_number().over(w).alias("place"))


def split_events(batch: DataFrame, batch_id: int, path: str) -> None:
    """A foreachBatch sink for parse_events(): valid rows below <path>/valid, the others below <path>/rejected, each in a folder of the batch's
    own, so that a batch that comes again writes the same rows in the same place."""
    with held(batch, "batch") as found:  # in storage: a micro-batch may be larger than the executors' memory
        for name, rows in (("valid", found.filter("is_valid")), ("rejected", found.filter("not is_valid"))):
            rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")

"""Work queues, checks of uploads, orphan files, recovery plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .access import active, resolve_content  # noqa: F401

#: Minutes that a bucket's cached files live.
LIFETIMES = {"ocr": 30}
DEFAULT_LIFETIME = 1440
MOST_BYTES = 100 * 1024 * 1024


def pending_ocr(documents: DataFrame) -> DataFrame:
    return active(documents).filter("status = 'Uploaded' and not is_ocred")


def pending_indexing(documents: DataFrame) -> DataFrame:
    return active(documents).filter("status = 'Succeeded' and is_ocred and not is_indexed")


def by_status(documents: DataFrame, status: str) -> DataFrame:
    return active(documents).filter(F.col("status") == status)


def jobs_by_status(jobs: DataFrame, stage: str, status: str) -> DataFrame:
    return jobs.filter(F.col(f"status_{stage}") == status)


def ilike_contains(text: Column, asked: str) -> Column:
    """Whether a text holds another, whatever the case; % and _ of what is asked for are wildcards."""
    return text.ilike(f"%{asked}%")


def ilike_prefix(text: Column, asked: str) -> Column:
    return text.ilike(f"{asked}%")


def stuck_uploads(documents: DataFrame, now: Column) -> DataFrame:
    return active(documents).filter((F.col("status") == "Uploading") & (F.col("created_at") < now - F.expr("interval 1 hour")))


def expired_files(objects: DataFrame, now: Column) -> DataFrame:
    """Cached objects older than their bucket's lifetime."""
    pairs = [x for k, v in LIFETIMES.items() for x in (F.lit(k), F.lit(v))]
    minutes = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("bucket")), F.lit(DEFAULT_LIFETIME))
    return objects.filter((F.unix_timestamp(now) - F.unix_timestamp("modified")) > minutes * 60)


def validate_uploads(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """batch (dataset_id, row_no, file_name, size) with its errors, joined by `; `, and whether it resumes an upload of that name."""
    name, size = F.col("file_name"), F.col("size")
    times = F.count("*").over(Window.partitionBy("dataset_id", F.lower("file_name")))
    held = existing.groupBy("dataset_id", F.lower("file_name").alias("_name")).agg(F.max(F.col("status") == "Uploading").alias("_open"), F.max(F.col("status") != "Uploading").alias("_taken"))
    joined = batch.withColumns({"_times": times, "_name": F.lower(name)}).join(held, ["dataset_id", "_name"], "left")
    taken = F.coalesce("_taken", F.lit(False))
    blank = name.isNull() | (F.trim(name) == "")
    errors = F.array_compact(F.array(
        F.when(blank, "name required"),
        F.when(~blank & ~F.lower(name).endswith(".pdf"), "only pdf"),
        F.when(F.coalesce(size, F.lit(0)) <= 0, "empty"),
        F.when(size > MOST_BYTES, "too large"),
        F.when(~blank & (F.col("_times") > 1), "duplicate in batch"),
        F.when(~blank & taken, "name taken"),
    ))
    return joined.select("dataset_id", "row_no", F.array_join(errors, "; ").alias("errors"), (F.coalesce("_open", F.lit(False)) & ~taken).alias("resumable"))


def duplicate_names(batch: DataFrame) -> DataFrame:
    """(dataset_id, name, n) of names that come more than once, whatever their case."""
    return batch.groupBy("dataset_id", F.lower("file_name").alias("name")).agg(F.count("*").alias("n")).filter("n > 1")


def indexable(documents: DataFrame) -> DataFrame:
    """(id, reason): why a document can't be indexed now, or ok."""
    reason = F.when(~F.col("is_ocred"), "not ocred").when(F.coalesce("ocr_content", F.lit("")) == "", "no content").when(F.col("status") == "ProcessingIndexing", "already indexing").otherwise("ok")
    return active(documents).select("id", reason.alias("reason"))


def verify_uploads(documents: DataFrame, objects: DataFrame) -> DataFrame:
    """(id, reason) of documents (id, object_key, file_size) against stored objects (key, size, head): missing, of another size, no PDF by
    its first bytes (head, binary, blanks before %PDF allowed), or ok."""
    found = objects.select(F.col("key").alias("object_key"), "size", "head").withColumn("_there", F.lit(True))
    pdf = F.regexp_replace(F.hex("head"), "^(20|09|0A|0B|0C|0D)+", "").startswith("25504446")
    reason = F.when(F.col("_there").isNull(), "missing").when(F.col("size") != F.col("file_size"), "size differs").when(~F.coalesce(pdf, F.lit(False)), "not a PDF").otherwise("ok")
    return documents.join(found, "object_key", "left").select("id", reason.alias("reason"))


def orphan_objects(objects: DataFrame, keys: DataFrame) -> DataFrame:
    """Objects whose key is no document's, neither whole nor as a base name, whatever the case."""
    known = keys.filter("object_key is not null").select(F.lower("object_key").alias("k")).distinct()
    whole = F.lower("key")
    base = F.substring_index(whole, "/", -1)
    return objects.filter("key is not null").withColumns({"_whole": whole, "_base": base}).join(known, F.col("_whole") == F.col("k"), "left_anti").join(known, F.col("_base") == F.col("k"), "left_anti").drop("_whole", "_base")


def job_order_violations(jobs: DataFrame) -> DataFrame:
    """Jobs whose indexing is under way or done though OCR isn't; an unknown OCR state passes, as in a CHECK constraint."""
    fits = ~F.col("status_indexing").isin("Processing", "Succeeded") | (F.col("status_ocr") == "Succeeded")
    return jobs.filter(~F.coalesce(fits, F.lit(True)))


def recover_ocr(documents: DataFrame) -> DataFrame:
    """(id, class, action): OCR under way is cancelled and sent again, waiting uploads are sent; without a key they fail or are skipped."""
    key = F.coalesce("object_key", F.lit("")) == ""
    kind = F.when(F.col("status") == "ProcessingOcr", "interrupted").when(F.col("status") == "Uploaded", "waiting")
    action = F.when(kind == "interrupted", F.when(key, "fail").otherwise("cancel and resubmit")).otherwise(F.when(key, "skip").otherwise("submit"))
    return active(documents).filter(kind.isNotNull()).select("id", kind.alias("class"), action.alias("action"))


def recovery_report(plan: DataFrame) -> DataFrame:
    """Counts of a plan by class, and of all of it."""
    counts = [F.count("*").alias("found"), *(F.count_if(F.col("action").isin(*v)).alias(k) for k, v in {"resubmitted": ("cancel and resubmit", "submit"), "skipped": ("skip",), "failed": ("fail",)}.items())]
    return plan.groupBy("class").agg(*counts).unionByName(plan.agg(*counts).select(F.lit("total").alias("class"), "found", "resubmitted", "skipped", "failed"))


def recover_indexing(documents: DataFrame) -> DataFrame:
    """(id, action, job_status) of documents whose indexing was interrupted: without content they fail, else they are queued again."""
    blank = F.trim(F.coalesce("ocr_content", F.lit(""))) == ""
    return by_status(documents, "ProcessingIndexing").select("id", F.when(blank, "fail").otherwise("requeue").alias("action"), F.when(blank, "Failed").otherwise("Pending").alias("job_status"))


def cleanup_plan(objects: DataFrame, keys: DataFrame, documents: DataFrame, now: Column) -> DataFrame:
    """(task, item) of what the periodic clean-up removes: orphan files, stuck uploads, expired files."""
    parts = [
        orphan_objects(objects, keys).select(F.lit("orphan").alias("task"), F.concat_ws("/", "bucket", "key").alias("item")),
        stuck_uploads(documents, now).select(F.lit("stuck").alias("task"), F.col("id").cast("string").alias("item")),
        expired_files(objects, now).select(F.lit("expired").alias("task"), F.concat_ws("/", "bucket", "key").alias("item")),
    ]
    return reduce(DataFrame.unionByName, parts)

"""Vector points of documents: ids, texts, payloads, replacement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docfoundry.functions.text import clean_response
from docfoundry.sources.versions import merge, read_current

from .lines import left_joined
from .metadata import finish_metadata


def point_id(document_id: Column, index: Column) -> Column:
    """The first 28 characters of the document's id and the index in little-endian hexadecimal."""
    h = F.lpad(F.hex(index.cast("long")), 8, "0")
    return F.concat(F.substring(document_id, 1, 28), F.lower(F.concat(*(F.substring(h, i, 2) for i in (7, 5, 3, 1)))))


def chunk_kind(kind: Column, needs_summary: Column, summary: Column) -> Column:
    short = needs_summary & (F.coalesce(summary, F.lit("")) != "")
    return F.when(kind == "Table", "table").when(short, "summary").otherwise("text")


def chunk_vector_text(kind: Column, needs_summary: Column, summary: Column, content: Column) -> Column:
    return F.when(chunk_kind(kind, needs_summary, summary) == "summary", summary).otherwise(content)


def build_points(chunks: DataFrame, payloads: DataFrame, embedder: Callable[[Column], Column], legacy_roundtrip: bool = False) -> DataFrame:
    """(point_id, document_id, dataset_id, vector, chunk_type, content, content_full, payload) of chunks (document_id, dataset_id,
    chunk_index, type, needs_summary, summary, content). payloads: (document_id, payload map). legacy_roundtrip forgets needs_summary."""
    needs = F.lit(False) if legacy_roundtrip else F.col("needs_summary")
    kind = chunk_kind(F.col("type"), needs, F.col("summary"))
    text = chunk_vector_text(F.col("type"), needs, F.col("summary"), F.col("content"))
    made = chunks.select("document_id", "dataset_id", point_id(F.col("document_id"), F.col("chunk_index")).alias("point_id"), kind.alias("chunk_type"), text.alias("content"), F.when(kind == "summary", F.col("content")).alias("content_full"))
    empty = F.create_map().cast("map<string,string>")
    return made.withColumn("vector", embedder(F.col("content"))).join(payloads, "document_id", "left").withColumn("payload", F.coalesce("payload", empty))


def point_collisions(points: DataFrame) -> DataFrame:
    """(point_id, n) of ids that several points have: ids keep 12 of a document id's 16 bytes."""
    return points.groupBy("point_id").agg(F.count("*").alias("n")).filter("n > 1")


def reindex_points(old: DataFrame, new: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """All points after those of the documents in `new` were replaced; documents: a table with the ids of these, if it takes less to read."""
    of = (new if documents is None else documents).select("document_id").distinct()
    return old.join(of, "document_id", "left_anti").unionByName(new)


def update_payload(points: DataFrame, payloads: DataFrame) -> DataFrame:
    """Points with the keys of (document_id, payload) set on their payload; other keys stay."""
    new = payloads.select("document_id", F.col("payload").alias("_new"))
    kept = F.map_filter("payload", lambda k, v: ~F.map_contains_key(F.col("_new"), k))
    return points.join(new, "document_id", "left").withColumn("payload", F.when(F.col("_new").isNull(), F.col("payload")).otherwise(F.map_concat(kept, "_new"))).drop("_new")


def index_key_changes(old: Column, new: Column) -> Column:
    """A struct of the index keys that a template lost and gained."""
    none = F.array().cast("array<string>")
    return F.struct(F.array_except(F.coalesce(old, none), F.coalesce(new, none)).alias("removed"), F.array_except(F.coalesce(new, none), F.coalesce(old, none)).alias("added"))


def write_points(points: DataFrame, path: str, files_per_dataset: int = 8) -> None:
    """Write points by dataset, replacing the datasets that come; a large dataset is spread over several files."""
    spread = points.repartition(F.col("dataset_id"), F.pmod(F.xxhash64("point_id"), F.lit(files_per_dataset)))
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset_id").parquet(path)


def replace_points(points: DataFrame, path: str, version: int, files_per_dataset: int = 8) -> bool:
    """Replace the points of the documents in `points` in storage, whatever dataset they were in, as `version`; False if that is done already.

    Points lie by dataset and bucket of their document. Only buckets that hold such documents, before or after, are written anew; files of
    the others keep their names.
    """
    bucket = F.pmod(F.xxhash64("document_id"), F.lit(files_per_dataset)).cast("int")
    return merge(points.withColumn("bucket", bucket), path, ["dataset_id", "bucket"], "document_id", version, elsewhere=True)


def read_points(spark: SparkSession, path: str) -> DataFrame | None:
    """The points that replace_points() has left; None before the first."""
    found = read_current(spark, path)
    return None if found is None else found.drop("bucket")


def new_points(chunks: DataFrame, cached: DataFrame, responses: DataFrame, metadata: DataFrame, known: DataFrame, templates: dict[str, str], embedder: Callable[[Column], Column]) -> DataFrame:
    """build_points() of chunks (document_id, dataset_id, chunk_index, type, needs_summary, content).

    A chunk that needs a summary takes the cached one (document_id, chunk_index, summary), else the response to its prompt (document_id,
    chunk_index, text), cleaned; without either it is indexed as text. Payloads are those known (document_id, payload as JSON), else what
    finish_metadata() makes of the responses (document_id, template, json).
    """
    key = ["document_id", "chunk_index"]
    answers = responses.select(*key, F.nullif(clean_response(F.col("text"), thinking=True), F.lit("")).alias("_made"))
    summaries = cached.select(*key, F.col("summary").alias("_cached")).join(answers, key, "full")
    # texts are dealt out once, by their documents, as payloads want them too
    summed = left_joined(chunks.select(*key, "dataset_id", "type", "needs_summary", "content"), summaries, key)
    summed = summed.withColumn("summary", F.when(F.col("needs_summary"), F.coalesce("_cached", "_made"))).drop("_cached", "_made")
    fresh = metadata.join(known.select("document_id"), "document_id", "left_anti").select("document_id", finish_metadata(F.col("template"), F.col("json"), templates)["payload"].alias("payload"))
    payloads = known.select("document_id", "payload").unionByName(fresh).select("document_id", F.from_json("payload", "map<string,string>").alias("payload"))
    return build_points(summed, payloads, embedder)


def index_documents(chunks: DataFrame, cached: DataFrame, responses: DataFrame, metadata: DataFrame, known: DataFrame, templates: dict[str, str], old: DataFrame, embedder: Callable[[Column], Column]) -> DataFrame:
    """All points after the documents of `chunks` were indexed: the old ones of other documents, and new_points()."""
    return reindex_points(old, new_points(chunks, cached, responses, metadata, known, templates, embedder).select(old.columns), chunks)


def index_in_storage(chunks: DataFrame, cached: DataFrame, responses: DataFrame, metadata: DataFrame, known: DataFrame, templates: dict[str, str], path: str, version: int, embedder: Callable[[Column], Column]) -> bool:
    """new_points(), computed once, in the place of the documents' old ones in storage; see replace_points()."""
    return replace_points(new_points(chunks, cached, responses, metadata, known, templates, embedder), path, version)

"""Counts over datasets, departments and documents, and the joins that listings show."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .access import active


def datasets_per_department(datasets: DataFrame) -> DataFrame:
    return active(datasets).filter("department_id is not null").groupBy("department_id").agg(F.count("*").alias("n_datasets"))


def dataset_overview(datasets: DataFrame, items: DataFrame) -> DataFrame:
    """(id, template_id, n_items, n_documents), 0 without items."""
    n = active(items).groupBy("dataset_id").agg(F.count("*").alias("n_items"), F.count("document_id").alias("n_documents"))
    return active(datasets).join(n, F.col("id") == F.col("dataset_id"), "left").select("id", "template_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_items", "n_documents")))


def department_statistics(datasets: DataFrame, documents: DataFrame) -> DataFrame:
    """Datasets, documents and bytes of every department (null is a department of its own), and of the company."""
    n = active(documents).groupBy("dataset_id").agg(F.count("*").alias("n"), F.sum("file_size").alias("b"))
    joined = active(datasets).join(n, F.col("id") == F.col("dataset_id"), "left")
    rolled = joined.rollup("department_id").agg(F.grouping_id().alias("g"), F.count("*").alias("n_datasets"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_documents"), F.coalesce(F.sum("b"), F.lit(0)).alias("n_bytes"))
    return rolled.select((F.col("g") == 1).alias("is_company"), "department_id", "n_datasets", "n_documents", "n_bytes")


def document_context(documents: DataFrame, items: DataFrame, datasets: DataFrame) -> DataFrame:
    """(document_id, item_id, dataset_id, template_id): a document's place and the template of its dataset, null where missing."""
    i = items.filter("document_id is not null").select("document_id", F.col("id").alias("item_id"), "dataset_id")
    d = datasets.select(F.col("id").alias("dataset_id"), "template_id")
    return documents.select(F.col("id").alias("document_id")).join(i, "document_id", "left").join(d, "dataset_id", "left").select("document_id", "item_id", "dataset_id", "template_id")


def document_details(documents: DataFrame, items: DataFrame, jobs: DataFrame) -> DataFrame:
    """Documents with path, job states and which contents they have."""
    i = items.filter("document_id is not null").select(F.col("document_id").alias("id"), "path")
    j = jobs.withColumnRenamed("document_id", "id")
    has = {f"has_{c}": F.coalesce(F.col(c), F.lit("")) != "" for c in ("ocr_content", "summary", "qa_summary")}
    return documents.join(i, "id", "left").join(j, "id", "left").withColumns(has).select("id", "file_name", "status", "path", "status_ocr", "status_indexing", *has)


def template_usage(templates: DataFrame, datasets: DataFrame) -> DataFrame:
    """(template_id, in_use) of every template."""
    used = datasets.filter("template_id is not null").select("template_id").distinct().withColumn("u", F.lit(True))
    return templates.select("template_id").distinct().join(used, "template_id", "left").select("template_id", F.coalesce("u", F.lit(False)).alias("in_use"))


def enrich_file_names(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """hits with their document's file name, empty where it is missing."""
    names = documents.select(F.col("id").alias("document_id"), "file_name")
    return hits.join(names, "document_id", "left").withColumn("file_name", F.coalesce("file_name", F.lit("")))

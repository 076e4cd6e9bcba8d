"""Queries of files, templates, artefacts."""

from __future__ import annotations

from pyspark.sql import functions as F

from docfoundry.sources import files

from .registry import query


@query("a3_load_templates", """WITH f AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE 't' || (c_custkey % 400) END AS name, c_custkey % 13 = 0 AS broken FROM customer),
 g AS (SELECT *, min(CASE WHEN NOT broken AND name IS NOT NULL THEN lpad(CAST(k AS STRING), 9, '0') END) OVER (PARTITION BY name) AS first FROM f)
 SELECT k, CASE WHEN broken OR name IS NULL THEN 'failed' WHEN name IN ('t1', 't2', 't3') OR lpad(CAST(k AS STRING), 9, '0') <> first THEN 'skipped' ELSE 'created' END AS outcome FROM g""")  # fmt: skip
def _(t):
    body = F.expr("""case when c_custkey % 13 = 0 then '{broken' when c_custkey % 10 = 0 then '{"jsonSchema":{"a":1}}' else concat('{"name":"t', c_custkey % 400, '","jsonSchema":{"type":"object"},"indexKeys":["a"]}') end""")
    read = t.customer.select(F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("path"), body.alias("value"))
    taken = t.customer.filter("c_custkey in (1, 2, 3)").select(F.concat(F.lit("t"), F.col("c_custkey").cast("string")).alias("name"))
    return files.load_templates(read, taken).select(F.col("path").cast("long").alias("k"), "outcome")


@query("a6_validate_files", """SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN 'content does not fit extension' WHEN 3 THEN 'unsupported extension' WHEN 4 THEN 'empty' ELSE '' END AS error FROM orders""")
def _(t):
    pick = lambda *v: F.element_at(F.array(*(F.lit(x) for x in v)), (F.col("o_orderkey") % 6 + 1).cast("int"))
    name = F.concat(F.col("o_orderkey").cast("string"), pick(".pdf", ".PNG", ".pdf", ".exe", ".jpg", ".webp"))
    content = F.unhex(pick("200A255044462D", "89504E470D0A", "EFBBBF25504446", "255044", "", "5249464600000000574542505650"))
    return files.validate_files(t.orders.select(name.alias("name"), content.alias("content"))).select(F.regexp_extract("name", r"^\d+", 0).cast("long").alias("id"), "error")


@query("a7_export_artifacts", """SELECT id, 'ocr-markdown' AS kind, 'file' || (id % 700) || '.md' AS name FROM document WHERE ocr_content IS NOT NULL UNION ALL SELECT id, 'chunks-markdown', 'file' || (id % 700) || '_Chunks.json' FROM document WHERE id % 2 = 0
 UNION ALL SELECT id, 'summary', 'file' || (id % 700) || '_Summary.md' FROM document WHERE summary IS NOT NULL UNION ALL SELECT id, 'original', file_name FROM document WHERE id % 3 <> 0""", "document")  # fmt: skip
def _(t):
    d = t.document.withColumn("chunks", F.when(F.col("id") % 2 == 0, "[]")).withColumn("object_key", F.when(F.col("id") % 3 != 0, F.concat(F.lit("in/"), "file_name")))
    return files.export_artifacts(d).unionByName(files.export_artifacts(d, "original")).select(F.col("doc_id").alias("id"), "kind", "name")


@query("a7_written_artifacts", """SELECT id, 'ocr-markdown' AS kind, 'file' || (id % 700) || '.md' AS name, ocr_content AS body FROM document WHERE ocr_content IS NOT NULL AND ocr_content <> '' UNION ALL SELECT id, 'summary', 'file' || (id % 700) || '_Summary.md', summary FROM document WHERE summary IS NOT NULL AND summary <> ''""", "document")
def _(t):
    """Artefacts written by kind, one kind written again, and read."""
    folder = files.scratch_folder(t.spark, "artifacts")
    found = files.export_artifacts(t.document.withColumn("chunks", F.lit(None).cast("string")))
    files.write_artifacts(found, folder)
    files.write_artifacts(found.filter("kind = 'summary'"), folder)
    return t.spark.read.parquet(folder).select(F.col("doc_id").alias("id"), "kind", "name", "body")


@query("a5_stored_objects", "SELECT lang AS key, CAST(sum(strlen(text) + 1) AS BIGINT) AS size FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL GROUP BY 1")
def _(t):
    """Texts written to a store by language, and the objects found there with their sizes."""
    folder = files.scratch_folder(t.spark, "objects")
    t.documents.filter("text is not null and lang is not null").select("lang", "text").write.partitionBy("lang").text(folder)
    objects = files.list_objects(t.spark, folder).withColumn("key", F.regexp_extract("key", "/lang=([^/]+)/", 1))
    return objects.filter("key <> ''").groupBy("key").agg(F.sum("size").alias("size"))

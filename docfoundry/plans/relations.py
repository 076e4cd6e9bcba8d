"""Queries of filters, joins, aggregates and access."""

from __future__ import annotations

from pyspark.sql import functions as F

from docfoundry.operators import access, summaries, tree, upkeep

from .registry import query

NOW = "1998-06-15 12:00:00"
_ACCESSIBLE = """accessible AS (
 SELECT owner_user_id AS user_id, id AS dataset_id FROM dataset WHERE NOT is_deleted
 UNION SELECT s.user_id, s.dataset_id FROM access_share s JOIN dataset d ON d.id = s.dataset_id WHERE NOT d.is_deleted AND s.user_id IS NOT NULL AND s.dataset_item_id IS NULL
 UNION SELECT u.user_id, d.id FROM user_department u JOIN dataset d ON d.department_id = u.department_id WHERE u.role = 'Manager' AND NOT d.is_deleted
 UNION SELECT u.user_id, s.dataset_id FROM access_share s JOIN dataset d ON d.id = s.dataset_id JOIN user_department u ON u.department_id = s.department_id WHERE NOT d.is_deleted AND s.dataset_item_id IS NULL)"""
_MASKS = """masks AS (SELECT user_id, dataset_id, CAST(bit_or(mask) AS INT) AS mask FROM (
 SELECT owner_user_id AS user_id, id AS dataset_id, 15 AS mask FROM dataset
 UNION ALL SELECT u.user_id, d.id, 1 FROM user_department u JOIN dataset d ON d.department_id = u.department_id WHERE u.role = 'Manager'
 UNION ALL SELECT user_id, dataset_id, mask FROM access_share WHERE user_id IS NOT NULL AND dataset_item_id IS NULL
 UNION ALL SELECT u.user_id, s.dataset_id, s.mask FROM access_share s JOIN user_department u ON u.department_id = s.department_id WHERE s.dataset_item_id IS NULL) m
 WHERE dataset_id IN (SELECT id FROM dataset) GROUP BY 1, 2)"""
_HIDDEN = """above AS (SELECT id, dataset_id, unnest(list_transform(range(2, len(string_split(path, '/')) - 1), lambda k: array_to_string(string_split(path, '/')[1:k], '/') || '/')) AS above FROM dataset_item),
 hidden AS (SELECT DISTINCT a.id FROM above a JOIN dataset_item f ON f.dataset_id = a.dataset_id AND f.path = a.above WHERE f.is_deleted AND f.item_type = 'Folder')"""


def rows(t, table: str, n: int):
    return getattr(t, table).filter(F.col("id") % n == 0)


@query("b1_active", "SELECT id, status FROM document WHERE NOT is_deleted", "document")
def _(t):
    return access.active(t.document).select("id", "status")


@query(
    "b2_work_queues",
    """SELECT 'ocr' AS queue, id FROM document WHERE NOT is_deleted AND status = 'Uploaded' AND NOT is_ocred
    UNION ALL SELECT 'indexing', id FROM document WHERE NOT is_deleted AND status = 'Succeeded' AND is_ocred AND NOT is_indexed
    UNION ALL SELECT 'failed', id FROM document WHERE NOT is_deleted AND status = 'Failed'
    UNION ALL SELECT 'job', document_id FROM document_job WHERE status_ocr = 'Pending'""",
    "document document_job",
)
def _(t):
    d = t.document
    tag = lambda q, x: x.select(F.lit(q).alias("queue"), F.col("id"))
    jobs = upkeep.jobs_by_status(t.document_job, "ocr", "Pending").withColumnRenamed("document_id", "id")
    return tag("ocr", upkeep.pending_ocr(d)).union(tag("indexing", upkeep.pending_indexing(d))).union(tag("failed", upkeep.by_status(d, "Failed"))).union(tag("job", jobs))


@query(
    "b3_resolve_content",
    """SELECT id, CASE id % 3 WHEN 0 THEN coalesce(summary, qa_summary) WHEN 1 THEN ocr_content END AS content FROM document""",
    "document",
)
def _(t):
    kind = F.element_at(F.array(F.lit("SUMMARY"), F.lit("FullContent"), F.lit("other")), (F.col("id") % 3 + 1).cast("int"))
    return t.document.select("id", upkeep.resolve_content(kind, F.col("summary"), F.col("qa_summary"), F.col("ocr_content")).alias("content"))


@query("b4_ilike", "SELECT id, name ILIKE '%RING%' AS holds, name ILIKE 'r_d%' AS begins FROM name_corpus", "name_corpus")
def _(t):
    return t.name_corpus.select("id", upkeep.ilike_contains(F.col("name"), "RING").alias("holds"), upkeep.ilike_prefix(F.col("name"), "r_d").alias("begins"))


@query("b5_stuck_uploads", f"SELECT id FROM document WHERE NOT is_deleted AND status = 'Uploading' AND created_at < TIMESTAMP '{NOW}' - INTERVAL 1 HOUR", "document")
def _(t):
    return upkeep.stuck_uploads(t.document, F.lit(NOW).cast("timestamp")).select("id")


@query("b6_expired_files", f"SELECT bucket, key FROM object WHERE epoch(TIMESTAMP '{NOW}') - epoch(modified) > 60 * CASE WHEN bucket = 'ocr' THEN 30 ELSE 1440 END", "object")
def _(t):
    return upkeep.expired_files(t.object, F.lit(NOW).cast("timestamp")).select("bucket", "key")


def upload_batch(t):
    return t.orders.select(
        F.col("o_custkey").alias("dataset_id"),
        F.col("o_orderkey").alias("row_no"),
        F.when(F.col("o_orderkey") % 29 == 0, None).otherwise(F.concat(F.lit("File"), (F.col("o_orderkey") % 700).cast("string"), F.when(F.col("o_orderkey") % 31 == 0, ".txt").otherwise(".PDF"))).alias("file_name"),
        F.when(F.col("o_orderkey") % 37 == 0, 0).otherwise(F.floor(F.col("o_totalprice") * 400)).cast("long").alias("size"),
    )


_BATCH = """batch AS (SELECT o_custkey AS dataset_id, o_orderkey AS row_no, CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE concat('file', o_orderkey % 700, CASE WHEN o_orderkey % 31 = 0 THEN '.txt' ELSE '.pdf' END) END AS name,
 CASE WHEN o_orderkey % 37 = 0 THEN 0 ELSE CAST(floor(o_totalprice * 400) AS BIGINT) END AS size FROM orders)"""


@query(
    "b7_validate_uploads",
    f"""WITH {_BATCH}, held AS (SELECT dataset_id, file_name AS name, bool_or(status = 'Uploading') AS o, bool_or(status <> 'Uploading') AS k FROM document GROUP BY 1, 2),
    j AS (SELECT b.*, count(*) OVER (PARTITION BY b.dataset_id, b.name) AS n, coalesce(h.o, false) AS o, coalesce(h.k, false) AS k FROM batch b LEFT JOIN held h ON h.dataset_id = b.dataset_id AND h.name = b.name)
    SELECT dataset_id, row_no, array_to_string(list_filter([CASE WHEN name IS NULL THEN 'name required' END, CASE WHEN name NOT LIKE '%.pdf' THEN 'only pdf' END, CASE WHEN size <= 0 THEN 'empty' END,
    CASE WHEN size > 104857600 THEN 'too large' END, CASE WHEN name IS NOT NULL AND n > 1 THEN 'duplicate in batch' END, CASE WHEN name IS NOT NULL AND k THEN 'name taken' END], lambda x: x IS NOT NULL), '; ') AS errors, o AND NOT k AS resumable FROM j""",
    "document",
)
def _(t):
    return upkeep.validate_uploads(upload_batch(t), t.document)


@query(
    "b8_indexable",
    """SELECT id, CASE WHEN NOT is_ocred THEN 'not ocred' WHEN ocr_content IS NULL THEN 'no content' WHEN status = 'ProcessingIndexing' THEN 'already indexing' ELSE 'ok' END AS reason FROM document WHERE NOT is_deleted""",
    "document",
)
def _(t):
    return upkeep.indexable(t.document)


@query(
    "b9_verify_uploads",
    """SELECT k.id, CASE WHEN o.key IS NULL THEN 'missing' WHEN o.size <> k.file_size THEN 'size differs' WHEN o.size % 29 = 0 THEN 'not a PDF' ELSE 'ok' END AS reason FROM document_key k LEFT JOIN object o ON o.key = k.object_key""",
    "document_key object",
)
def _(t):
    head = F.when(F.col("size") % 29 == 0, "PK junk").otherwise(F.when(F.col("size") % 2 == 0, " \n%PDF-1.7").otherwise("%PDF-1.4"))
    return upkeep.verify_uploads(t.document_key, t.object.withColumn("head", F.encode(head, "utf-8")))


@query(
    "c1_document_context",
    """SELECT d.id AS document_id, i.id AS item_id, i.dataset_id, s.template_id FROM document d LEFT JOIN dataset_item i ON i.document_id = d.id LEFT JOIN dataset s ON s.id = i.dataset_id""",
    "document dataset_item dataset",
)
def _(t):
    return summaries.document_context(t.document, t.dataset_item, t.dataset)


@query(
    "c2_item_listing",
    f"""WITH {_HIDDEN} SELECT i.id, i.path, d.file_name, d.status AS document_status, d.file_size, j.status_ocr, j.status_indexing FROM dataset_item i
    LEFT JOIN document d ON d.id = i.document_id LEFT JOIN document_job j ON j.document_id = i.document_id LEFT JOIN hidden x ON x.id = i.id WHERE NOT i.is_deleted AND x.id IS NULL""",
    "dataset_item document document_job",
)
def _(t):
    return tree.item_listing(t.dataset_item, t.document, t.document_job).select("id", "path", "file_name", "document_status", "file_size", "status_ocr", "status_indexing")


@query(
    "c3_accessible_documents",
    f"WITH {_ACCESSIBLE} SELECT DISTINCT a.user_id, i.document_id FROM accessible a JOIN dataset_item i ON i.dataset_id = a.dataset_id WHERE i.document_id IS NOT NULL",
    "dataset access_share user_department dataset_item",
)
def _(t):
    return access.accessible_documents(t.dataset_item, access.accessible_datasets(t.dataset, t.access_share, t.user_department))


@query("c4_hide_deleted_descendants", f"WITH {_HIDDEN} SELECT i.id, path FROM dataset_item i LEFT JOIN hidden x ON x.id = i.id WHERE NOT is_deleted AND x.id IS NULL", "dataset_item")
def _(t):
    return tree.hide_deleted_descendants(t.dataset_item).select("id", "path")


@query(
    "c6_orphan_objects",
    """SELECT bucket, key FROM object WHERE lower(key) NOT IN (SELECT lower(object_key) FROM document_key WHERE NOT is_deleted)
    AND regexp_extract(lower(key), '[^/]*$') NOT IN (SELECT lower(object_key) FROM document_key WHERE NOT is_deleted)""",
    "object document_key",
)
def _(t):
    return upkeep.orphan_objects(t.object, access.active(t.document_key)).select("bucket", "key")


@query("c7_enrich_file_names", "SELECT p.point_id, coalesce(d.file_name, '') AS file_name FROM point p LEFT JOIN document d ON d.id = p.document_id * 100", "point document")
def _(t):
    hits = t.point.select("point_id", (F.col("document_id") * 100).alias("document_id"))
    return summaries.enrich_file_names(hits, t.document).select("point_id", "file_name")


@query("c8_job_order_violations", "SELECT document_id FROM document_job WHERE NOT coalesce(status_indexing NOT IN ('Processing', 'Succeeded') OR status_ocr = 'Succeeded', true)", "document_job")
def _(t):
    return upkeep.job_order_violations(t.document_job).select("document_id")


@query(
    "c9_dataset_documents",
    f"""WITH {_ACCESSIBLE} SELECT a.user_id, i.dataset_id, i.document_id, d.file_name FROM accessible a JOIN dataset_item i ON i.dataset_id = a.dataset_id JOIN document d ON d.id = i.document_id""",
    "dataset access_share user_department dataset_item document",
)
def _(t):
    every = access.accessible_datasets(t.dataset, t.access_share, t.user_department)
    return access.dataset_documents(t.dataset_item, t.document, every)


@query(
    "c11_document_details",
    """SELECT d.id, d.file_name, d.status, i.path, j.status_ocr, j.status_indexing, d.ocr_content IS NOT NULL AS has_ocr_content, d.summary IS NOT NULL AS has_summary, d.qa_summary IS NOT NULL AS has_qa_summary
    FROM document d LEFT JOIN dataset_item i ON i.document_id = d.id LEFT JOIN document_job j ON j.document_id = d.id""",
    "document dataset_item document_job",
)
def _(t):
    return summaries.document_details(t.document, t.dataset_item, t.document_job)


@query("c12_template_usage", "SELECT DISTINCT n_name AS template_id, n_name IN (SELECT template_id FROM dataset) AS in_use FROM nation UNION SELECT template_id, true FROM dataset", "dataset")
def _(t):
    templates = t.nation.select(F.col("n_name").alias("template_id")).union(t.dataset.select("template_id"))
    return summaries.template_usage(templates, t.dataset)


@query("c13_share_lookup", "SELECT dataset_id, user_id, department_id, mask FROM access_share WHERE user_id = 7 AND dataset_item_id IS NOT NULL UNION ALL SELECT dataset_id, user_id, department_id, mask FROM access_share WHERE dataset_id = 11 AND department_id = 2", "access_share")
def _(t):
    a = access.share_lookup(t.access_share, user_id=7).filter("dataset_item_id is not null")
    return a.union(access.share_lookup(t.access_share, dataset_id=11, department_id=2)).select("dataset_id", "user_id", "department_id", "mask")


@query("d1_datasets_per_department", "SELECT department_id, count(*) AS n_datasets FROM dataset WHERE NOT is_deleted AND department_id IS NOT NULL GROUP BY 1", "dataset")
def _(t):
    return summaries.datasets_per_department(t.dataset)


@query(
    "d2_dataset_overview",
    """SELECT d.id, d.template_id, count(i.id) AS n_items, count(i.document_id) AS n_documents FROM dataset d LEFT JOIN dataset_item i ON i.dataset_id = d.id AND NOT i.is_deleted WHERE NOT d.is_deleted GROUP BY 1, 2""",
    "dataset dataset_item",
)
def _(t):
    return summaries.dataset_overview(t.dataset, t.dataset_item)


@query("d3_child_counts", "SELECT parent_id, count(*) AS n_children FROM dataset_item WHERE NOT is_deleted AND parent_id IS NOT NULL GROUP BY 1", "dataset_item")
def _(t):
    return tree.child_counts(t.dataset_item)


@query("d4_duplicate_names", f"WITH {_BATCH} SELECT dataset_id, name, count(*) AS n FROM batch GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return upkeep.duplicate_names(upload_batch(t))


@query("d5_effective_permissions", f"WITH {_MASKS} SELECT user_id, dataset_id, mask FROM masks", "dataset access_share user_department")
def _(t):
    return access.effective_permissions(t.dataset, t.access_share, t.user_department)


@query(
    "d6_effective_item_permissions",
    f"""WITH {_MASKS}, own AS (SELECT s.user_id, s.dataset_item_id AS item_id, i.dataset_id, bit_or(s.mask) AS mask FROM access_share s JOIN dataset_item i ON i.id = s.dataset_item_id WHERE s.user_id IS NOT NULL GROUP BY 1, 2, 3)
    SELECT o.user_id, o.item_id, CASE WHEN m.mask = 15 THEN 15 ELSE CAST(coalesce(m.mask, 0) | o.mask AS INT) END AS mask FROM own o LEFT JOIN masks m ON m.user_id = o.user_id AND m.dataset_id = o.dataset_id""",
    "dataset access_share user_department dataset_item",
)
def _(t):
    masks = access.effective_permissions(t.dataset, t.access_share, t.user_department)
    return access.effective_item_permissions(masks, t.dataset_item, t.access_share)


@query(
    "d7_can",
    f"WITH {_MASKS} SELECT user_id, count(*) FILTER (mask & 1 = 1) AS n_view, count(*) FILTER (mask & 3 = 3) AS n_write, count(*) FILTER (mask & 4 = 4) AS n_delete, count(*) FILTER (mask & 8 = 8) AS n_share FROM masks GROUP BY 1",
    "dataset access_share user_department",
)
def _(t):
    m = access.effective_permissions(t.dataset, t.access_share, t.user_department)
    flags = {"n_view": access.READ, "n_write": access.READ | access.UPDATE, "n_delete": access.DELETE, "n_share": access.SHARE}
    return m.groupBy("user_id").agg(*(F.count_if(access.can(F.col("mask"), p)).alias(k) for k, p in flags.items()))


@query(
    "d8_department_statistics",
    """WITH x AS (SELECT s.id, s.department_id, count(d.id) AS n, coalesce(sum(d.file_size), 0) AS b FROM dataset s LEFT JOIN document d ON d.dataset_id = s.id AND NOT d.is_deleted WHERE NOT s.is_deleted GROUP BY 1, 2)
    SELECT false AS is_company, department_id, count(*) AS n_datasets, CAST(sum(n) AS BIGINT) AS n_documents, CAST(sum(b) AS BIGINT) AS n_bytes FROM x GROUP BY department_id
    UNION ALL SELECT true, NULL, count(*), CAST(coalesce(sum(n), 0) AS BIGINT), CAST(coalesce(sum(b), 0) AS BIGINT) FROM x""",
    "dataset document",
)
def _(t):
    return summaries.department_statistics(t.dataset, t.document)


_PLAN = """plan AS (SELECT id, CASE status WHEN 'ProcessingOcr' THEN 'interrupted' ELSE 'waiting' END AS class,
 CASE WHEN status = 'ProcessingOcr' THEN CASE WHEN id % 5 = 0 THEN 'fail' ELSE 'cancel and resubmit' END WHEN id % 5 = 0 THEN 'skip' ELSE 'submit' END AS action
 FROM document_key WHERE NOT is_deleted AND status IN ('ProcessingOcr', 'Uploaded'))"""


def ocr_plan(t):
    return upkeep.recover_ocr(t.document_key.withColumn("object_key", F.when(F.col("id") % 5 != 0, F.col("object_key"))))


@query(
    "d9_recovery_report",
    f"""WITH {_PLAN}, p AS (SELECT class, action FROM plan UNION ALL SELECT 'total', action FROM plan) SELECT class, count(*) AS found,
    count(*) FILTER (action IN ('cancel and resubmit', 'submit')) AS resubmitted, count(*) FILTER (action = 'skip') AS skipped, count(*) FILTER (action = 'fail') AS failed FROM p GROUP BY 1""",
    "document_key",
)
def _(t):
    return upkeep.recovery_report(ocr_plan(t))


@query("g1_accessible_datasets", f"WITH {_ACCESSIBLE} SELECT user_id, dataset_id FROM accessible UNION SELECT 48, id FROM dataset WHERE NOT is_deleted", "dataset access_share user_department")
def _(t):
    return access.accessible_datasets(t.dataset, t.access_share, t.user_department, admins=[48])


@query(
    "g3_denied_datasets",
    f"WITH {_ACCESSIBLE} SELECT o_orderkey AS request_id, o_custkey % 50 AS user_id, o_orderkey % 1000 AS dataset_id FROM orders WHERE (o_custkey % 50, o_orderkey % 1000) NOT IN (SELECT (user_id, dataset_id) FROM accessible)",
    "dataset access_share user_department",
)
def _(t):
    asked = t.orders.selectExpr("o_orderkey as request_id", "o_custkey % 50 as user_id", "o_orderkey % 1000 as dataset_id")
    return access.denied(asked, access.accessible_datasets(t.dataset, t.access_share, t.user_department)).select("request_id", "user_id", "dataset_id")


@query(
    "g6_purge",
    """WITH gone AS (SELECT id FROM dataset WHERE is_deleted AND id % 2 = 0) SELECT 'datasets' AS part, id FROM dataset WHERE id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'items', id FROM dataset_item WHERE dataset_id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'documents', id FROM document WHERE id NOT IN (SELECT document_id FROM dataset_item WHERE document_id IS NOT NULL AND dataset_id IN (SELECT id FROM gone))
    UNION ALL SELECT 'shares', count(*) FROM access_share WHERE dataset_id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'folder', i.id FROM dataset_item i WHERE NOT EXISTS (SELECT 1 FROM dataset_item f WHERE f.is_deleted AND f.item_type = 'Folder' AND f.dataset_id = i.dataset_id AND starts_with(i.path, f.path))""",
    "dataset dataset_item document access_share",
)
def _(t):
    left = tree.purge(t.dataset, t.dataset_item, t.document, t.access_share, t.dataset.filter("id % 2 = 0"))
    tag = lambda k, x: x.select(F.lit(k).alias("part"), F.col("id").cast("long").alias("id"))
    shares = left["shares"].agg(F.count("*").alias("id"))
    return tag("datasets", left["datasets"]).union(tag("items", left["items"])).union(tag("documents", left["documents"])).union(tag("shares", shares)).union(tag("folder", tree.purge_folders(t.dataset_item, t.dataset_item)))


@query("k21_recover_ocr", f"WITH {_PLAN} SELECT id, class, action FROM plan", "document_key")
def _(t):
    return ocr_plan(t)


@query("k22_recover_indexing", "SELECT id, CASE WHEN ocr_content IS NULL THEN 'fail' ELSE 'requeue' END AS action, CASE WHEN ocr_content IS NULL THEN 'Failed' ELSE 'Pending' END AS job_status FROM document WHERE NOT is_deleted AND status = 'ProcessingIndexing'", "document")
def _(t):
    return upkeep.recover_indexing(t.document)


@query(
    "k24_cleanup_plan",
    f"""SELECT 'orphan' AS task, concat(bucket, '/', key) AS item FROM object WHERE lower(key) NOT IN (SELECT lower(object_key) FROM document_key) AND regexp_extract(lower(key), '[^/]*$') NOT IN (SELECT lower(object_key) FROM document_key)
    UNION ALL SELECT 'stuck', CAST(id AS STRING) FROM document WHERE NOT is_deleted AND status = 'Uploading' AND created_at < TIMESTAMP '{NOW}' - INTERVAL 1 HOUR
    UNION ALL SELECT 'expired', concat(bucket, '/', key) FROM object WHERE epoch(TIMESTAMP '{NOW}') - epoch(modified) > 60 * CASE WHEN bucket = 'ocr' THEN 30 ELSE 1440 END""",
    "object document_key document",
)
def _(t):
    return upkeep.cleanup_plan(t.object, t.document_key, t.document, F.lit(NOW).cast("timestamp"))

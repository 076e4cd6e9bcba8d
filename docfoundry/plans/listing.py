"""Queries of pages, folders, trash."""

from __future__ import annotations

from pyspark.sql import functions as F

from docfoundry.operators import paging, tree

from .registry import query
from .relations import _HIDDEN


@query("e7_append_sort_order", """WITH b AS (SELECT o_custkey AS dataset_id, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey * 1000000 + year(o_orderdate) * 100 END AS parent_id, o_orderkey AS row_no FROM orders),
 m AS (SELECT dataset_id, parent_id, max(sort_order) AS m FROM dataset_item GROUP BY 1, 2)
 SELECT b.dataset_id, b.parent_id, b.row_no, CAST(coalesce(m.m, -1) + row_number() OVER (PARTITION BY b.dataset_id, b.parent_id ORDER BY b.row_no) AS INT) AS sort_order
 FROM b LEFT JOIN m ON m.dataset_id = b.dataset_id AND m.parent_id IS NOT DISTINCT FROM b.parent_id""", "dataset_item")  # fmt: skip
def _(t):
    batch = t.orders.selectExpr("o_custkey as dataset_id", "case when o_orderkey % 2 = 0 then o_custkey * 1000000 + year(o_orderdate) * 100 end as parent_id", "o_orderkey as row_no")
    return tree.append_sort_order(t.dataset_item, batch).withColumn("sort_order", F.col("sort_order").cast("int"))


@query("f1_page_by_created", "SELECT id FROM document WHERE created_at < TIMESTAMP '1997-05-28' OR (created_at = TIMESTAMP '1997-05-28' AND id < 900) ORDER BY created_at DESC, id DESC LIMIT 50", "document")
def _(t):
    return paging.page_by_created(t.document, 50, (F.lit("1997-05-28").cast("timestamp"), F.lit(900))).select("id")


@query("f2_page_by_updated", "SELECT id FROM document WHERE updated_at < TIMESTAMP '1997-05-28' OR (updated_at = TIMESTAMP '1997-05-28' AND id < 900) ORDER BY CASE WHEN status IN ('ProcessingOcr', 'ProcessingIndexing') THEN 0 ELSE 1 END, updated_at DESC, id DESC LIMIT 80", "document")
def _(t):
    return paging.page_by_updated(t.document, 80, (F.lit("1997-05-28").cast("timestamp"), F.lit(900))).select("id")


@query("f3_page_offset", "SELECT id, (SELECT count(*) FROM dataset) AS total, CAST(ceil((SELECT count(*) FROM dataset) / 20.0) AS INT) AS pages FROM dataset ORDER BY updated_at DESC, id DESC LIMIT 20 OFFSET 40", "dataset")
def _(t):
    page, total, pages = paging.page_offset(t.dataset, 3, 500)
    return page.select("id", F.lit(total).cast("long").alias("total"), F.lit(pages).alias("pages"))


@query("f6_folder_listing", "SELECT id, parent_id, row_number() OVER (PARTITION BY dataset_id, parent_id ORDER BY item_type, sort_order, name, id) AS place FROM dataset_item", "dataset_item")
def _(t):
    return paging.folder_listing(t.dataset_item).select("id", "parent_id", F.col("place").cast("long").alias("place"))


@query("f7_recent_threads", """SELECT user_id, conv_id, rank FROM (SELECT conv_id % 20 AS user_id, conv_id, row_number() OVER (PARTITION BY conv_id % 20 ORDER BY conv_id DESC) AS rank FROM conversations WHERE turn = 0 AND text ILIKE '%on%') x WHERE rank <= 20""")
def _(t):
    threads = t.conversations.filter("turn = 0").filter(F.col("text").ilike("%on%")).select((F.col("conv_id") % 20).alias("user_id"), "conv_id")
    return paging.newest_per(threads, "user_id", [F.desc("conv_id")], 20).select("user_id", "conv_id", F.col("rank").cast("long").alias("rank"))


@query("f8_owned_datasets", "SELECT owner_user_id, id, row_number() OVER (PARTITION BY owner_user_id ORDER BY updated_at DESC, id DESC) AS rank FROM dataset WHERE NOT is_deleted", "dataset")
def _(t):
    own = t.dataset.filter("not is_deleted")
    return paging.newest_per(own, "owner_user_id", [F.desc("updated_at"), F.desc("id")], 1 << 30).select("owner_user_id", "id", F.col("rank").cast("long").alias("rank"))


@query("h28_item_path", "SELECT id, CASE WHEN parent_id IS NULL THEN concat('/', name, '/') ELSE regexp_replace(path, '[^/]*/$', '') || name || '/' END AS made FROM dataset_item", "dataset_item")
def _(t):
    i = t.dataset_item
    parents = i.select(F.col("id").alias("parent_id"), F.col("path").alias("above"))
    return i.join(parents, "parent_id", "left").select("id", tree.item_path(F.col("above"), F.col("name")).alias("made"))


@query("k19_trash_items", f"""WITH {_HIDDEN} SELECT 'Dataset' AS kind, id FROM dataset WHERE is_deleted UNION ALL
 SELECT item_type, i.id FROM dataset_item i LEFT JOIN hidden x ON x.id = i.id LEFT JOIN dataset d ON d.id = i.dataset_id AND d.is_deleted WHERE i.is_deleted AND x.id IS NULL AND d.id IS NULL""", "dataset dataset_item")  # fmt: skip
def _(t):
    return tree.trash(t.dataset, t.dataset_item)


@query("k20_soft_delete", """WITH t AS (SELECT id, document_id FROM dataset_item WHERE id % 10 = 4) SELECT 'item' AS kind, i.id, is_deleted OR t.id IS NOT NULL AS is_deleted FROM dataset_item i LEFT JOIN t ON t.id = i.id
 UNION ALL SELECT 'document', d.id, is_deleted OR t.id IS NOT NULL FROM document d LEFT JOIN t ON t.document_id = d.id""", "dataset_item document")  # fmt: skip
def _(t):
    items, docs = tree.set_deleted(t.dataset_item, t.document, t.dataset_item.filter("id % 10 = 4"), True)
    return items.selectExpr("'item' as kind", "id", "is_deleted").union(docs.selectExpr("'document' as kind", "id", "is_deleted"))


@query("k20_restore", """WITH t AS (SELECT id, document_id FROM dataset_item WHERE id % 10 = 4) SELECT 'item' AS kind, i.id, is_deleted AND t.id IS NULL AS is_deleted FROM dataset_item i LEFT JOIN t ON t.id = i.id
 UNION ALL SELECT 'document', d.id, is_deleted AND t.id IS NULL FROM document d LEFT JOIN t ON t.document_id = d.id""", "dataset_item document")  # fmt: skip
def _(t):
    items, docs = tree.set_deleted(t.dataset_item, t.document, t.dataset_item.filter("id % 10 = 4"), False)
    return items.selectExpr("'item' as kind", "id", "is_deleted").union(docs.selectExpr("'document' as kind", "id", "is_deleted"))

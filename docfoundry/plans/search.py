"""Queries of name search, vector search, points."""

from __future__ import annotations

from pyspark.sql import functions as F

from docfoundry.operators import access, points, search

from .registry import query
from .relations import _ACCESSIBLE

_GRAMS = """list_distinct(flatten(list_transform(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"""
_SIM = """WITH q AS (SELECT query_id, text, {q} AS g FROM name_query), n AS (SELECT id, name, {n} AS g FROM name_corpus),
 p AS (SELECT query_id, id, text, name, len(list_intersect(q.g, n.g)) AS k, len(q.g) AS nq, len(n.g) AS nn FROM q, n),
 s AS (SELECT query_id, id, text, name, k, k / (nq + nn - k) AS similarity FROM p)""".format(q=_GRAMS.format(x="text"), n=_GRAMS.format(x="name"))


@query("h9_trigram_similarity", f"{_SIM} SELECT query_id, id, round(similarity, 4) AS similarity FROM s WHERE k > 0", "name_query name_corpus")
def _(t):
    # pairs without a trigram in common have a similarity of 0, and are not listed
    return search.trigram_join(t.name_query, t.name_corpus, 1e-9, digits=4)


@query("c10_trigram_join", f"{_SIM} SELECT query_id, id, round(similarity, 4) AS similarity FROM s WHERE similarity >= 0.3", "name_query name_corpus")
def _(t):
    return search.trigram_join(t.name_query, t.name_corpus, digits=4)


@query(
    "f4_name_search_top20",
    f"""{_SIM}, r AS (SELECT query_id, id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, id) AS rank FROM s WHERE similarity >= 0.3 OR contains(lower(name), lower(text)))
    SELECT query_id, id, round(similarity, 4) AS similarity, CAST(rank AS INT) AS rank FROM r WHERE rank <= 20""",
    "name_query name_corpus",
)
def _(t):
    return search.name_search(t.name_query, t.name_corpus).withColumn("similarity", F.round("similarity", 4))


def requests(t):
    return t.embeddings.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("request_id"), F.col("embedding").alias("vector"))


_SCORES = """s AS (SELECT r.vec_id AS request_id, p.point_id, p.document_id, p.dataset_id, p.chunk_type, p.content, p.content_full, p.document_type, p.year, p.score_value, p.flag,
 list_cosine_similarity(CAST(r.embedding AS DOUBLE[]), CAST(p.vector AS DOUBLE[])) AS score FROM embeddings r, point p WHERE r.vec_id % 50 = 0)"""


@query(
    "f5_vector_top_k",
    f"WITH {_SCORES}, k AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, point_id) AS rank FROM s WHERE score >= 0.3) SELECT request_id, point_id, round(score, 4) AS score, CAST(rank AS INT) AS rank FROM k WHERE rank <= 10",
    "point",
)
def _(t):
    return search.vector_top_k(requests(t), t.point).select("request_id", "point_id", F.round("score", 4).alias("score"), "rank")


@query(
    "e6_first_point_per_document",
    f"""WITH {_SCORES}, k AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, point_id) AS rank FROM s WHERE score >= 0.1),
    e AS (SELECT *, row_number() OVER (PARTITION BY request_id, document_id ORDER BY rank) AS n FROM k WHERE rank <= 100) SELECT request_id, document_id, point_id FROM e WHERE n = 1""",
    "point",
)
def _(t):
    return search.first_point_per_document(search.vector_top_k(requests(t), t.point, k=100, threshold=0.1)).select("request_id", "document_id", "point_id")


@query(
    "h21_metadata_filter",
    """SELECT point_id FROM point WHERE document_type = 'report' AND year = 2008 UNION ALL SELECT point_id FROM point WHERE score_value >= 0.25 AND score_value <= 0.5 AND NOT flag
    UNION ALL SELECT point_id FROM point WHERE score_value = 0.25 UNION ALL SELECT point_id FROM point WHERE point_id % 5 = 3 OR point_id % 7 = 3""",
    "point",
)
def _(t):
    p = t.point.withColumn("score_value", F.col("score_value").cast("double"))
    a = p.filter(search.metadata_filter({"document_type": "report", "year": 2008}))
    b = p.filter(search.metadata_filter({"score_value": (0.25, 0.5), "flag": False}))
    c = p.filter(search.metadata_filter({"score_value": 0.25}))
    tags = p.withColumn("tags", F.array(F.col("point_id") % 5, F.col("point_id") % 7))
    d = tags.filter(search.metadata_filter({"tags": 3}, ("tags",))).drop("tags")
    return a.union(b).union(c).union(d).select("point_id")


@query(
    "h30_distances",
    """SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) AS cosine, round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) AS dot,
    round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) AS euclid FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def _(t):
    pairs = t.embeddings.select("vec_id", "embedding").join(t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    return pairs.select("vec_id", *(F.round(search.distance(k, F.col("embedding"), F.col("other")), 4).alias(k) for k in search.DISTANCES))


def accessible(t):
    return access.accessible_datasets(t.dataset, t.access_share, t.user_department)


def asking(t):
    """requests() of users; every other one for two datasets, which not all of them may see."""
    return requests(t).withColumn("user_id", (F.col("request_id") / 50).cast("long") % 50)


def wanting(asked):
    n = (F.col("request_id") / 50).cast("long")
    return asked.filter("request_id % 100 = 0").select("request_id", F.explode(F.array(n % 9 + 1, n % 7 + 1)).alias("dataset_id"))


_USER = "CAST(floor(request_id / 50) AS BIGINT)"
_GRANTED = f"""{_ACCESSIBLE}, wants AS (SELECT request_id, user_id, unnest([{_USER} % 9 + 1, {_USER} % 7 + 1]) AS dataset_id FROM asked WHERE request_id % 100 = 0),
 barred AS (SELECT DISTINCT request_id FROM wants WHERE (user_id, dataset_id) NOT IN (SELECT (user_id, dataset_id) FROM accessible)),
 granted AS (SELECT DISTINCT request_id, dataset_id FROM wants WHERE request_id NOT IN (SELECT request_id FROM barred) UNION ALL SELECT request_id, dataset_id FROM asked JOIN accessible a ON a.user_id = asked.user_id WHERE request_id % 100 <> 0)"""


@query(
    "k16_vector_search",
    f"""WITH {_SCORES}, asked AS (SELECT vec_id AS request_id, CAST(floor(vec_id / 50) AS BIGINT) % 50 AS user_id FROM embeddings WHERE vec_id % 50 = 0), {_GRANTED},
    a AS (SELECT s.* FROM s JOIN granted g ON g.request_id = s.request_id AND g.dataset_id = s.dataset_id WHERE document_type <> 'memo' AND year >= 2003),
    k AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, point_id) AS rank FROM a WHERE score >= 0.05), e AS (SELECT *, row_number() OVER (PARTITION BY request_id, document_id ORDER BY rank) AS n FROM k WHERE rank <= 10)
    SELECT e.request_id, e.document_id, e.point_id, round(e.score, 4) AS score, CASE WHEN chunk_type = 'summary' THEN content_full ELSE content END AS content, coalesce(d.file_name, '') AS file_name FROM e LEFT JOIN document d ON d.id = e.document_id WHERE n = 1""",
    "point dataset document access_share user_department",
)
def _(t):
    asked = asking(t)
    allowed = search.granted(asked, wanting(asked), accessible(t), t.point)
    seen = t.point.filter("document_type <> 'memo'")
    return search.vector_search(asked, seen, t.document, allowed, {"year": (2003, None)}, threshold=0.05).withColumn("score", F.round("score", 4))


@query(
    "k17_name_search",
    f"""{_SIM}, asked AS (SELECT query_id AS request_id, user_id FROM name_query), {_GRANTED},
    a AS (SELECT s.query_id, s.id, row_number() OVER (PARTITION BY s.query_id ORDER BY round(similarity, 9) DESC, s.id) AS rank FROM s JOIN name_corpus c ON c.id = s.id JOIN granted g ON g.request_id = s.query_id AND g.dataset_id = c.dataset_id
    WHERE similarity >= 0.3 OR contains(lower(s.name), lower(s.text))) SELECT query_id, id, CAST(rank AS INT) AS rank FROM a WHERE rank <= 20""",
    "name_query name_corpus dataset access_share user_department",
)
def _(t):
    asked = t.name_query.withColumnRenamed("query_id", "request_id")
    return search.name_search(t.name_query, t.name_corpus, allowed=search.granted(asked, wanting(asked), accessible(t), t.name_corpus)).select("query_id", "id", "rank")


_UUID = "substr(md5(CAST(o_orderkey AS STRING)), 1, 8) || '-' || substr(md5(CAST(o_orderkey AS STRING)), 9, 4) || '-4000-8000-' || substr(md5(CAST(o_orderkey AS STRING)), 13, 12)"


@query("h26_point_id", f"WITH x AS (SELECT o_orderkey AS id, {_UUID} AS u, lpad(lower(hex(CAST(o_orderkey AS INT))), 8, '0') AS h FROM orders) SELECT id, substr(u, 1, 28) || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS point_id FROM x")
def _(t):
    return t.orders.select(F.col("o_orderkey").alias("id"), points.point_id(F.expr(_UUID), F.col("o_orderkey")).alias("point_id"))


def chunk_rows(t):
    return t.orders.selectExpr(
        "cast(o_custkey as string) as document_id", "o_custkey % 7 as dataset_id", "o_orderkey as chunk_index", "case o_orderkey % 3 when 0 then 'Table' when 1 then 'Text' else 'Summary' end as type",
        "o_orderkey % 3 = 2 as needs_summary", "case when o_orderkey % 5 = 0 then '' else concat('s', o_orderkey) end as summary", "concat('c', o_orderkey) as content",
    )


@query("h27_chunk_kind", """SELECT o_orderkey AS chunk_index, CASE WHEN o_orderkey % 3 = 0 THEN 'table' WHEN o_orderkey % 3 = 2 AND o_orderkey % 5 <> 0 THEN 'summary' ELSE 'text' END AS kind,
 CASE WHEN o_orderkey % 3 = 2 AND o_orderkey % 5 <> 0 THEN 's' || o_orderkey ELSE 'c' || o_orderkey END AS text FROM orders""")  # fmt: skip
def _(t):
    c = [F.col(x) for x in ("type", "needs_summary", "summary", "content")]
    return chunk_rows(t).select("chunk_index", points.chunk_kind(*c[:3]).alias("kind"), points.chunk_vector_text(*c).alias("text"))


def built(t):
    payloads = t.customer.selectExpr("cast(c_custkey as string) as document_id", "map('segment', c_mktsegment, 'nation', cast(c_nationkey as string)) as payload").filter("document_id % 4 <> 0")
    return points.build_points(chunk_rows(t), payloads, lambda text: F.array(F.length(text).cast("float"), F.crc32(text).cast("float")))


@query("k14_build_points", """SELECT o_custkey % 7 AS dataset_id, substr(CAST(o_custkey AS STRING), 1, 28) || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS point_id,
 CASE WHEN o_orderkey % 3 = 0 THEN 'table' WHEN o_orderkey % 3 = 2 AND o_orderkey % 5 <> 0 THEN 'summary' ELSE 'text' END AS chunk_type, CASE WHEN o_orderkey % 3 = 2 AND o_orderkey % 5 <> 0 THEN 'c' || o_orderkey END AS content_full,
 CASE WHEN o_custkey % 4 <> 0 THEN c_mktsegment END AS segment FROM (SELECT *, lpad(lower(hex(CAST(o_orderkey AS INT))), 8, '0') AS h FROM orders) o LEFT JOIN customer ON c_custkey = o_custkey""")  # fmt: skip
def _(t):
    return built(t).select("dataset_id", "point_id", "chunk_type", "content_full", F.col("payload")["segment"].alias("segment"))


@query("g5_reindex_points", """SELECT point_id, content FROM point WHERE document_id % 5 <> 0 UNION ALL SELECT point_id + 1000000, 'new' FROM point WHERE document_id % 5 = 0 AND point_id % 2 = 0""", "point")
def _(t):
    old = t.point.select("point_id", "document_id", "content")
    new = old.filter("document_id % 5 = 0 and point_id % 2 = 0").select((F.col("point_id") + 1000000).alias("point_id"), "document_id", F.lit("new").alias("content"))
    return points.reindex_points(old, new).select("point_id", "content")


@query("g5_replace_in_storage", """SELECT point_id, content, dataset_id FROM point WHERE document_id % 5 <> 0 UNION ALL SELECT point_id + 1000000, 'new', CASE WHEN document_id % 3 = 0 THEN (dataset_id + 1) % 10 ELSE dataset_id END FROM point WHERE document_id % 5 = 0 AND point_id % 2 = 0""", "point")
def _(t):
    """Points in storage; documents' points replaced there, some in another dataset, and the replacement sent twice."""
    from docfoundry.sources.files import scratch_folder

    folder = scratch_folder(t.spark, "store")
    old = t.point.select("point_id", "document_id", F.col("dataset_id").cast("int").alias("dataset_id"), "content")
    moved = F.when(F.col("document_id") % 3 == 0, (F.col("dataset_id") + 1) % 10).otherwise(F.col("dataset_id")).cast("int")
    new = old.filter("document_id % 5 = 0 and point_id % 2 = 0").select((F.col("point_id") + 1000000).alias("point_id"), "document_id", moved.alias("dataset_id"), F.lit("new").alias("content"))
    for version, rows in ((1, old), (2, new), (2, new)):
        points.replace_points(rows, folder, version, files_per_dataset=4)
    return points.read_points(t.spark, folder).select("point_id", "content", "dataset_id")


@query("k15_update_payload", """SELECT point_id, CASE WHEN document_id % 3 = 0 THEN 'new' ELSE document_type END AS document_type, CAST(year AS STRING) AS year, CASE WHEN document_id % 3 = 0 THEN 'x' END AS extra FROM point""", "point")
def _(t):
    p = t.point.withColumn("payload", F.create_map(F.lit("document_type"), "document_type", F.lit("year"), F.col("year").cast("string")))
    new = p.select("document_id").distinct().filter("document_id % 3 = 0").withColumn("payload", F.create_map(F.lit("document_type"), F.lit("new"), F.lit("extra"), F.lit("x")))
    out = points.update_payload(p, new)
    return out.select("point_id", *(F.try_element_at("payload", F.lit(k)).alias(k) for k in ("document_type", "year", "extra")))


@query("g4_index_key_changes", """WITH x AS (SELECT c_custkey AS id, ['a', c_mktsegment, 'n' || c_nationkey % 3] AS o, [c_mktsegment, 'b', 'n' || c_custkey % 3] AS n FROM customer)
 SELECT id, array_to_string(list_sort(list_filter(o, lambda v: NOT list_contains(n, v))), ',') AS removed, array_to_string(list_sort(list_filter(n, lambda v: NOT list_contains(o, v))), ',') AS added FROM x""")  # fmt: skip
def _(t):
    c = t.customer.selectExpr("c_custkey as id", "array('a', c_mktsegment, concat('n', c_nationkey % 3)) as o", "array(c_mktsegment, 'b', concat('n', c_custkey % 3)) as n")
    d = c.select("id", points.index_key_changes(F.col("o"), F.col("n")).alias("d"))
    return d.select("id", F.array_join(F.array_sort("d.removed"), ",").alias("removed"), F.array_join(F.array_sort("d.added"), ",").alias("added"))

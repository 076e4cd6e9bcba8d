"""Queries of texts, keys, metadata, access requests for documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from docfoundry.functions import text
from docfoundry.operators import lines, metadata, tree

from .registry import query
from .relations import _ACCESSIBLE

SCHEMA = """{"type":"object","required":["kind","year","note"],"additionalProperties":false,"properties":{"kind":{"enum":["Report","Báo cáo","Letter"]},
"year":{"type":"integer"},"note":{"type":"string","maxLength":12},"when":{"type":["string","null"],"format":"date"},"ok":{"type":"boolean"},
"amount":{"type":"number"},"who":{"type":"object","properties":{"name":{"type":"string"},"role":{"oneOf":[{"type":"null"},{"enum":["Boss","Staff"]}]}}},"tags":{"type":"array","items":{"type":"string"}}}}"""


def metadata_raw(t):
    """(doc_id, json): metadata with enum values in the wrong case or without marks, blanks, numbers as texts, lists; one in fifty isn't JSON."""
    i = "doc_id"
    return t.documents.selectExpr(
        "doc_id",
        f"""case when {i} % 50 = 0 then 'oops' else concat('{{"kind":"', case {i} % 4 when 0 then 'report' when 1 then 'BAO CAO' when 2 then 'Letter' else '' end, '","year":',
        case {i} % 3 when 0 then '2001' when 1 then '"2002"' else 'null' end, ',"note":"', case {i} % 5 when 0 then '' else concat('n', {i}) end, '","amount":"', {i} % 9, '.5","ok":"true","who":{{"name":"A","role":"boss"}},"tags":["x",null,"y"]}}') end as json""",
    )


@query("h1_split_pages", r"""WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), p AS (SELECT doc_id, list_transform(range(0, CAST(ceil(len(l) / 6.0) AS BIGINT)), lambda i: trim(array_to_string(l[i * 6 + 1 : i * 6 + 6], chr(10)), ' ' || chr(10) || chr(9) || chr(13))) AS p FROM x)
 SELECT doc_id, CAST(len(list_filter(p, lambda v: v <> '')) AS INT) AS n_pages, array_to_string(list_filter(p, lambda v: v <> ''), '|') AS pages FROM p""")  # fmt: skip
def _(t):
    from docfoundry.sources.files import assemble_document

    from .structure import ocr_page

    pages = ocr_page(t).withColumn("markdown", F.regexp_replace("markdown", r"\n!\[p\]\(k\.jpg\)$", ""))
    split = assemble_document(pages).select("doc_id", text.split_pages(F.col("text")).alias("p"))
    return split.select("doc_id", F.size("p").alias("n_pages"), F.array_join("p", "|").alias("pages"))


@query("a2_assemble_document", """WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), p AS (SELECT doc_id, unnest(range(0, CAST(ceil(len(l) / 6.0) AS BIGINT))) AS i, l FROM x)
 SELECT doc_id, string_agg(array_to_string(l[i * 6 + 1 : i * 6 + 6], chr(10)) || chr(10) || '![p](k.jpg)' || chr(10) || 'Page ' || (i + 1) || chr(10) || chr(10) || '---' || chr(10), '' ORDER BY i) AS text FROM p GROUP BY 1""")  # fmt: skip
def _(t):
    from docfoundry.sources.files import assemble_document

    from .structure import ocr_page

    return assemble_document(ocr_page(t))


@query("f10_first_pages", r"""WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), p AS (SELECT doc_id, list_transform(range(0, CAST(ceil(len(l) / 6.0) AS BIGINT)), lambda i: trim(array_to_string(l[i * 6 + 1 : i * 6 + 6], chr(10)) || chr(10) || '![p](k.jpg)', ' ' || chr(10) || chr(9) || chr(13))) AS p FROM x)
 SELECT doc_id, array_to_string(p[1:2], chr(10) || chr(10) || '---' || chr(10) || chr(10)) AS text FROM p""")
def _(t):
    from docfoundry.sources.files import assemble_document

    from .structure import ocr_page

    return assemble_document(ocr_page(t)).select("doc_id", text.first_pages(F.col("text"), 2).alias("text"))


@query("h2_normalize_object_key", r"""WITH x AS (SELECT page_id, trim(regexp_replace(url, '^.*/', '')) AS stem FROM pages),
 y AS (SELECT page_id, trim(lower(regexp_replace(regexp_replace(regexp_replace(stem, '\s+', '-', 'g'), '[\\{}^%`\]\["<>#|?$&]', '-', 'g'), '-{2,}', '-', 'g')), '-') AS k FROM x)
 SELECT page_id, 'in/' || CASE WHEN k = '' THEN 'none' ELSE k END || '.pdf' AS key FROM y""")  # fmt: skip
def _(t):
    stem = F.regexp_replace("url", "^.*/", "")
    return t.pages.select("page_id", text.normalize_object_key(F.concat(F.lit("in/"), stem, F.lit(".PDF")), F.lit("none")).alias("key"))


@query("h13_rewrite_image_links", """SELECT doc_id, text || ' ![' || source || '](http://s/' || lang || '/page1_k' || doc_id % 7 || '.jpg) b <IMG class="c" src="http://s/' || lang || '/page1_k' || doc_id % 7 || '.jpg" alt="d"> ![y](other.jpg)' AS text FROM documents""")
def _(t):
    key = F.concat(F.lit("k"), (F.col("doc_id") % 7).cast("string"), F.lit(".jpg"))
    md = F.concat("text", F.lit(" !["), "source", F.lit("]("), key, F.lit(') b <IMG class="c" src="'), key, F.lit('" alt="d"> ![y](other.jpg)'))
    return t.documents.select("doc_id", text.rewrite_image_links(md, F.array(key), F.concat(F.lit("http://s/"), "lang", F.lit("/page1_"))).alias("text"))


@query("h14_fold_text", "SELECT doc_id, lower(strip_accents(text)) AS text FROM documents")
def _(t):
    return t.documents.select("doc_id", text.fold_text("text").alias("text"))


@query("h29_last_path_element", "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_type END AS last FROM part")
def _(t):
    path = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.concat_ws(" --> ", "p_name", "p_brand", "p_type"))
    return t.part.select(F.col("p_partkey").alias("id"), tree.last_path_element(path).alias("last"))


@query("h31_count_tokens", "SELECT doc_id, CAST(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')) AS BIGINT) AS tokens FROM documents")
def _(t):
    return t.documents.select("doc_id", lines.count_tokens(F.col("text")).alias("tokens"))


@query("h32_parse_departments", """SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE 2 END AS n, CASE WHEN c_custkey % 7 <> 0 THEN CASE WHEN c_nationkey % 2 = 0 THEN 'Manager' ELSE 'Staff' END END AS role FROM customer""")
def _(t):
    claim = F.expr("case when c_custkey % 7 = 0 then 'bad' else concat('[{\"Id\":\"', c_nationkey, '\",\"IsPrimary\":true,\"Role\":\"', case when c_nationkey % 2 = 0 then 'Manager' else 'Staff' end, '\"},{\"Id\":\"x\",\"Role\":\"Staff\"}]') end")
    d = t.customer.select(F.col("c_custkey").alias("id"), text.parse_departments(claim).alias("d"))
    return d.select("id", F.size("d").alias("n"), F.get("d", F.lit(0))["role"].alias("role"))


def template(t):
    """(template_id, json_schema): a schema for each customer, its properties and types by nation and segment."""
    own = """concat('{"type":"object","properties":{"', c_name, '":', case c_custkey % 9 when 0 then '{"type":"integer"}' when 1 then '{"type":["null","number"]}' when 2 then '{"type":"boolean"}'
     when 3 then '{"type":"string","format":"date"}' when 4 then '{"oneOf":[{"type":"null"},{"enum":["A","B"]}]}' when 5 then '{"type":"array","items":{"type":"string"}}' when 6 then '{"type":"string","format":"date-time"}'
     when 7 then '{"oneOf":[{"type":"null"},{"type":"integer"}]}' else '{"type":"string"}' end, ',"', c_mktsegment, '":{"type":"object","properties":{"x":{"type":"integer"}}}}}') as json_schema"""
    return t.customer.selectExpr("c_custkey as template_id", own)


@query("h17_h18_template_rules", """SELECT c_custkey AS template_id, c_name AS key, CASE c_custkey % 9 WHEN 0 THEN 'integer' WHEN 1 THEN 'float' WHEN 2 THEN 'bool' WHEN 3 THEN 'datetime' WHEN 6 THEN 'datetime' WHEN 7 THEN 'integer' ELSE 'keyword' END AS index_type,
 CASE c_custkey % 9 WHEN 0 THEN '0' WHEN 1 THEN '0' WHEN 2 THEN 'false' WHEN 3 THEN '"0001-01-01"' WHEN 4 THEN '"other"' WHEN 5 THEN '[]' WHEN 6 THEN '"0001-01-01T00:00:00"' WHEN 7 THEN '0' ELSE '""' END AS default_value FROM customer
 UNION ALL SELECT c_custkey, c_mktsegment, 'keyword', '""' FROM customer""")  # fmt: skip
def _(t):
    return metadata.template_rules(template(t))


def typed(t):
    """metadata_raw() with numbers and truth values that aren't texts."""
    return metadata_raw(t).withColumn("json", F.regexp_replace(F.regexp_replace("json", '"amount":"([^"]*)"', '"amount":$1'), '"ok":"true"', '"ok":true'))


_VALID = "doc_id % 50 <> 0 AND doc_id % 3 <> 1"
_KIND = "CASE doc_id % 4 WHEN 0 THEN 'Report' WHEN 1 THEN 'Báo cáo' WHEN 2 THEN 'Letter' ELSE 'other' END"


@query("k12_finish_metadata", f"""SELECT doc_id, {_VALID} AS is_valid, CASE WHEN doc_id % 50 = 0 THEN 'not JSON' WHEN doc_id % 3 = 1 THEN 'year: invalid' ELSE '' END AS errors, {_VALID} AS extracted,
 CASE WHEN {_VALID} THEN {_KIND} ELSE 'other' END AS kind, CASE WHEN {_VALID} AND doc_id % 3 = 0 THEN '2001' ELSE '0' END AS year, CASE WHEN {_VALID} AND doc_id % 5 <> 0 THEN 'n' || doc_id ELSE '' END AS note FROM documents""")  # fmt: skip
def _(t):
    m = typed(t).select("doc_id", metadata.finish_metadata(F.lit("t"), F.col("json"), {"t": SCHEMA}).alias("m"))
    at = lambda k: F.get_json_object("m.json", f"$.{k}").alias(k)
    return m.select("doc_id", "m.is_valid", "m.errors", "m.extracted", at("kind"), at("year"), at("note"))


@query("h15_normalize_enum", f"SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN NULL WHEN doc_id % 4 = 3 THEN '' ELSE {_KIND} END AS kind, CASE WHEN doc_id % 50 <> 0 THEN 'Boss' END AS role FROM documents")
def _(t):
    m = metadata_raw(t).select("doc_id", metadata.normalize_enum(F.lit("t"), F.col("json"), {"t": SCHEMA}).alias("j"))
    return m.select("doc_id", F.get_json_object("j", "$.kind").alias("kind"), F.get_json_object("j", "$.who.role").alias("role"))


@query("h16_coerce_required", """SELECT doc_id, CASE WHEN doc_id % 50 <> 0 THEN CASE doc_id % 3 WHEN 0 THEN '2001' WHEN 1 THEN '2002' ELSE '0' END END AS year, CASE WHEN doc_id % 50 <> 0 THEN CASE doc_id % 4 WHEN 0 THEN 'report' WHEN 1 THEN 'BAO CAO' WHEN 2 THEN 'Letter' ELSE 'other' END END AS kind FROM documents""")
def _(t):
    m = metadata_raw(t).select("doc_id", metadata.coerce_required(F.lit("t"), F.col("json"), {"t": SCHEMA}).alias("j"))
    return m.select("doc_id", F.get_json_object("j", "$.year").alias("year"), F.get_json_object("j", "$.kind").alias("kind"))


@query("h19_flatten_payload", """SELECT doc_id, CASE WHEN doc_id % 50 <> 0 THEN CASE doc_id % 3 WHEN 0 THEN '2001' WHEN 1 THEN '2002' END END AS year, CASE WHEN doc_id % 50 <> 0 THEN 'A' END AS who_name, CASE WHEN doc_id % 50 <> 0 THEN '["x","y"]' END AS tags,
 CASE WHEN doc_id % 50 <> 0 THEN doc_id % 9 || '.5' END AS amount, CASE WHEN doc_id % 50 <> 0 THEN 'true' END AS ok FROM documents""")  # fmt: skip
def _(t):
    m = metadata_raw(t).select("doc_id", metadata.flatten_payload(F.lit("t"), F.col("json"), {"t": SCHEMA}).alias("j"))
    at = lambda k: F.get_json_object("j", f"$['{k}']")
    return m.select("doc_id", at("year").alias("year"), at("who.name").alias("who_name"), at("tags").alias("tags"), at("amount").alias("amount"), at("ok").alias("ok"))


@query("h20_validate_metadata", """SELECT doc_id, false AS is_valid, CASE WHEN doc_id % 50 = 0 THEN 'not JSON' ELSE array_to_string(list_filter([CASE WHEN doc_id % 4 <> 2 THEN 'kind: invalid' END, CASE WHEN doc_id % 3 <> 0 THEN 'year: invalid' END,
 'ok: invalid', 'amount: invalid', 'who.role: invalid'], lambda v: v IS NOT NULL), '; ') END AS errors FROM documents""")  # fmt: skip
def _(t):
    m = metadata_raw(t).select("doc_id", metadata.validate_metadata(F.lit("t"), F.col("json"), {"t": SCHEMA}).alias("m"))
    return m.select("doc_id", "m.is_valid", "m.errors")


@query("k18_read_documents", f"""WITH {_ACCESSIBLE}, r AS (SELECT id AS request_id, id, id % 50 AS user_id, CASE id % 3 WHEN 0 THEN 'Summary' WHEN 1 THEN 'fullcontent' ELSE 'x' END AS kind FROM document UNION ALL SELECT -1 - c_custkey, -1 - c_custkey, 1, 'summary' FROM customer),
 j AS (SELECT r.*, d.id IS NOT NULL AS there, a.user_id IS NOT NULL AS may, summary, qa_summary, ocr_content FROM r LEFT JOIN document d ON d.id = r.id AND NOT d.is_deleted LEFT JOIN accessible a ON a.user_id = r.user_id AND a.dataset_id = d.dataset_id)
 SELECT request_id, id, CASE WHEN NOT there THEN 'not found' WHEN NOT may THEN 'denied' ELSE 'ok' END AS outcome, CASE WHEN there AND may THEN CASE lower(kind) WHEN 'summary' THEN coalesce(summary, qa_summary) WHEN 'fullcontent' THEN ocr_content END END AS content FROM j""", "document dataset access_share user_department")  # fmt: skip
def _(t):
    from docfoundry.operators import access

    kind = F.element_at(F.array(F.lit("Summary"), F.lit("fullcontent"), F.lit("x")), (F.col("id") % 3 + 1).cast("int"))
    known = t.document.select(F.col("id").alias("request_id"), "id", (F.col("id") % 50).alias("user_id"), kind.alias("content_type"))
    unknown = t.customer.select((-1 - F.col("c_custkey")).alias("request_id"), (-1 - F.col("c_custkey")).alias("id"), F.lit(1).cast("long").alias("user_id"), F.lit("summary").alias("content_type"))
    return access.read_documents(known.union(unknown), t.document, access.accessible_datasets(t.dataset, t.access_share, t.user_department))

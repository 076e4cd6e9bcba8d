"""Queries of lines, chunks, sections, tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docfoundry.operators import chunking, lines, tables

from .registry import query

LIMIT = 64


def ocr_document(t) -> DataFrame:
    """documents as OCR'd Markdown: every third line becomes a heading of level 1, 2 or 3, some empty or trailing headings are added."""
    each = t.documents.select("doc_id", F.split("text", "\n").alias("l"))
    head = lambda x, i: F.when(i % 12 == 0, F.concat(F.lit("# "), x)).when(i % 6 == 0, F.concat(F.lit("## "), x)).when(i % 3 == 0, F.concat(F.lit("### "), x)).otherwise(x)
    marked = F.transform("l", head)
    middle = F.when(F.col("doc_id") % 4 == 0, F.concat(F.slice(marked, 1, 6), F.array(F.lit("## Empty")), F.slice(marked, F.lit(7), F.greatest(F.size("l"), F.lit(1))))).otherwise(marked)
    whole = F.when(F.col("doc_id") % 5 == 0, F.array_append(middle, F.lit("# Appendix"))).otherwise(middle)
    return each.select("doc_id", F.array_join(whole, "\n").alias("text"))


_OCR = """raw AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
 marked AS (SELECT doc_id, list_transform(l, lambda x, i: CASE WHEN i % 12 = 1 THEN '# ' WHEN i % 6 = 1 THEN '## ' WHEN i % 3 = 1 THEN '### ' ELSE '' END || x) AS l FROM raw),
 middle AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN list_concat(l[1:6], ['## Empty'], l[7:]) ELSE l END AS l FROM marked),
 ocr AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN list_append(l, '# Appendix') ELSE l END AS l FROM middle),
 opened AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM ocr)"""


def ocr_page(t) -> DataFrame:
    """(doc_id, page_index, markdown, images): six lines to a page, each with a picture; every third page's is empty."""
    each = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    pages = each.groupBy("doc_id", F.floor(F.col("i") / 6).cast("int").alias("page_index")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("md"))
    image = F.when(F.col("page_index") % 3 == 2, "").otherwise("eA==")
    return pages.select("doc_id", "page_index", F.concat("md", F.lit("\n![p](k.jpg)")).alias("markdown"), F.create_map(F.lit("k.jpg"), image).alias("images"))


_HEADERS = {
    "1-URGENT": ["Name", "Amount", "Date"],
    "2-HIGH": ["Name", "Amounts", "Date"],
    "3-MEDIUM": ["Item", "Qty"],
    "4-NOT SPECIFIED": ["Item name", "Qty", "Price", "Total"],
    "5-LOW": ["name ", "amount", "dates"],
}


def md_table(t) -> DataFrame:
    """(doc_id, table_index, has_header, header_cells, column_count, row_count): a customer's orders as tables, their items as rows."""
    heads = F.create_map(*(x for k, v in _HEADERS.items() for x in (F.lit(k), F.lit(v))))
    n = t.lineitem.groupBy("l_orderkey").agg(F.count("*").cast("int").alias("row_count"))
    o = t.orders.join(n, F.col("l_orderkey") == F.col("o_orderkey"), "left").withColumn("h", F.coalesce(F.try_element_at(heads, "o_orderpriority"), F.lit(["Other"])))
    index = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return o.select(F.col("o_custkey").alias("doc_id"), index.alias("table_index"), (F.col("o_orderkey") % 3 != 2).alias("has_header"), F.col("h").alias("header_cells"), F.size("h").alias("column_count"), F.coalesce("row_count", F.lit(0)).alias("row_count"))


def table_document(t) -> DataFrame:
    """(doc_id, text): the tables of a customer as Markdown pages, a document for each run of twelve; doc_id is the customer times 10**9 and the run."""
    m = md_table(t).withColumn("doc_id", F.expr("cast(doc_id as bigint) * 1000000000 + (table_index - 1) div 12"))
    head = F.concat(F.lit("| "), F.array_join("header_cells", " | "), F.lit(" |\n|"), F.repeat(F.lit("---|"), F.col("column_count")))
    rows = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest("row_count", F.lit(1))), lambda i: F.concat(F.lit("| "), i.cast("string"), F.repeat(F.lit(" | x"), F.col("column_count") - 1), F.lit(" |"))), "\n")
    page = F.concat(F.lit("## Section "), F.col("table_index").cast("string"), F.lit("\n\nText before.\n\n"), head, F.lit("\n"), rows)
    pages = F.sort_array(F.collect_list(F.struct("table_index", page.alias("p"))))
    return m.groupBy("doc_id").agg(F.array_join(F.transform(pages, lambda x: x["p"]), "\n\n").alias("text"))


_NL = "chr(10)"
_HEADS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in _HEADERS.items())
_MD = f"""md AS (SELECT o_custkey AS cust, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS table_index, o_orderkey % 3 <> 2 AS has_header, CASE o_orderpriority {_HEADS} ELSE ['Other'] END AS h, coalesce(n, 0) AS row_count
 FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey)"""
_PLACED = f"""{_MD}, page AS (SELECT cust * 1000000000 + (table_index - 1) // 12 AS doc_id, table_index, h, greatest(row_count, 1) AS k, '## Section ' || table_index || {_NL} || {_NL} || 'Text before.' || {_NL} || {_NL} AS front,
 '| ' || array_to_string(h, ' | ') || ' |' || {_NL} || '|' || repeat('---|', len(h)) || {_NL} || array_to_string(list_transform(range(1, greatest(row_count, 1) + 1), lambda i: '| ' || i || repeat(' | x', len(h) - 1) || ' |'), {_NL}) AS body FROM md),
 placed AS (SELECT *, row_number() OVER w AS j, coalesce(sum(length(front) + length(body) + 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(front) AS "start", coalesce(sum(k + 7) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 5 AS first_n
 FROM page WINDOW w AS (PARTITION BY doc_id ORDER BY table_index)),
 paged AS (SELECT doc_id, string_agg(front || body, {_NL} || {_NL} ORDER BY table_index) AS text FROM page GROUP BY 1)"""
_BI = "CASE WHEN length({x}) > 1 THEN list_distinct(list_transform(range(1, length({x})), lambda i: substring({x}, i, 2))) ELSE [] END"
_DICE = "CASE WHEN {a} = {b} THEN 1.0 WHEN length({a}) < 2 OR length({b}) < 2 THEN 0.0 ELSE 2.0 * len(list_intersect({x}, {y})) / (len({x}) + len({y})) END"


def dice_sql(a: str, b: str) -> str:
    return _DICE.format(a=a, b=b, x=f"({_BI.format(x=a)})", y=f"({_BI.format(x=b)})")


_CELL = f"CASE WHEN x = '' OR y = '' THEN 0.0 WHEN x = y THEN 1.0 WHEN contains(x, y) OR contains(y, x) THEN 0.8 WHEN {dice_sql('x', 'y')} >= 0.6 THEN 0.6 ELSE 0.0 END"
_SIMILAR = f"""hs AS (SELECT DISTINCT h, array_to_string(h, '|') AS k FROM md), cells AS (SELECT a.k AS a, b.k AS b, len(a.h) AS n, len(b.h) AS m, lower(trim(a.h[i])) AS x, lower(trim(b.h[i])) AS y FROM hs a, hs b, range(1, 10) r(i) WHERE i <= least(len(a.h), len(b.h))),
 sim AS (SELECT a, b, CAST(sum({_CELL}) AS DOUBLE) / least(n, m) * (CAST(least(n, m) AS DOUBLE) / greatest(n, m)) AS s FROM cells GROUP BY a, b, n, m), simmap AS (SELECT map(list(a || '~' || b), list(s)) AS sims FROM sim)"""


def fold_sql(tables: str, policy: str) -> str:
    """fold: the decision on each row of `tables` (doc_id, j, key, c, has_header), one after the other."""
    column = "CASE WHEN r.c = t.c THEN 1.0 WHEN abs(r.c - t.c) = 1 THEN 0.4 ELSE 0.0 END"
    scores = f"list_transform(f.refs, lambda r: CASE WHEN t.has_header THEN 0.8 * f.sims[r.k || '~' || t.key] + 0.2 * {column} ELSE 0.7 + 0.2 * {column} END)"
    own = "CASE WHEN {h} THEN [{{'k': {t}.key, 'c': {t}.c, 'j': {t}.j}}] ELSE [] END"
    return f"""{_SIMILAR}, fold AS (SELECT t.doc_id, t.j, 1 AS segment, CAST([] AS DOUBLE[]) AS scores, [{{'k': t.key, 'c': t.c, 'j': t.j}}][1:0] AS used, {own.format(h='t.has_header', t='t')} AS refs, 'first' AS method, false AS merged, sims FROM {tables} t, simmap WHERE t.j = 1
 UNION ALL SELECT doc_id, j, CASE WHEN merged THEN segment ELSE segment + 1 END, scores, used, CASE WHEN merged THEN list_concat(used, own) ELSE own END, method, merged, sims FROM (
 SELECT *, coalesce(sure, {str(policy == 'merge').lower()}) AS merged, CASE WHEN sure IS NULL THEN 'grey' ELSE 'heuristic' END AS method FROM (
 SELECT *, CASE WHEN len(scores) = 0 THEN NULL WHEN list_min(scores) >= 0.7 THEN true WHEN list_max(scores) <= 0.25 THEN false END AS sure FROM (
 SELECT t.doc_id, t.j, f.segment, {scores} AS scores, f.refs AS used, {own.format(h='t.has_header', t='t')} AS own, f.sims FROM fold f JOIN {tables} t ON t.doc_id = f.doc_id AND t.j = f.j + 1) a) b) c)"""


_BY_CUSTOMER = "cand AS (SELECT cust AS doc_id, table_index AS j, array_to_string(h, '|') AS key, len(h) AS c, has_header FROM md)"
_BY_PAGE = "cand AS (SELECT doc_id, j, array_to_string(h, '|') AS key, len(h) AS c, true AS has_header FROM placed)"
_SPANS = f"""{_BY_PAGE}, {fold_sql('cand', 'merge')}, spans AS (SELECT f.doc_id, f.segment, min(p."start") AS "start", max(p."start" + length(p.body) - 1) AS "end", min(p.table_index) AS first FROM fold f JOIN placed p ON p.doc_id = f.doc_id AND p.j = f.j GROUP BY 1, 2),
 tchunk AS (SELECT s.*, substring(d.text, CAST(s."start" + 1 AS BIGINT), CAST(s."end" - s."start" + 1 AS BIGINT)) AS content FROM spans s JOIN paged d ON d.doc_id = s.doc_id)"""
_TOKENS = "len(regexp_extract_all({x}, '[^ \\t\\n\\r\\f\\v]+'))"


def parts_sql(source: str, is_open: str, depth: int = 5) -> str:
    """frag: the uncut parts of `source` (doc_id, text), as SURVEY's set form has them. is_open: a condition on tokens."""
    steps, last = [], "sect0"
    for k in range(1, depth + 1):
        w = f"PARTITION BY doc_id, p{k - 1} ORDER BY n"
        over = f"(sum(tokens) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
        opened = is_open.format(tokens=over)
        steps.append(f"""cut{k} AS (SELECT *, CASE WHEN {opened} THEN max(CASE WHEN level = {k} THEN n END) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS c{k},
 {opened} AND max(CASE WHEN level = {k} THEN 1 ELSE 0 END) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) = 1 AS any{k} FROM {last}),
 sect{k} AS (SELECT *, coalesce(c{k}, p{k - 1}) AS p{k} FROM cut{k})""")
        last = f"sect{k}"
    ks = range(1, depth + 1)
    began = "CASE " + " ".join(f"WHEN level = {k} AND c{k} IS NOT NULL THEN {k}" for k in ks) + " ELSE 0 END"
    keep = " AND ".join(f"(c{k} IS NOT NULL OR NOT any{k})" for k in ks)
    path = "concat_ws(' --> ', " + ", ".join(f"CASE WHEN q[{k}] THEN last_value(CASE WHEN begins = {k} THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END" for k in ks) + ")"
    return f"""split AS (SELECT doc_id, unnest(string_split(text, {_NL})) AS line, generate_subscripts(string_split(text, {_NL}), 1) AS n, len(string_split(text, {_NL})) AS k FROM {source}),
 lined AS (SELECT *, CASE WHEN regexp_matches(line, '^#{{1,6}}([ \\t]|$)') THEN length(regexp_extract(line, '^#+')) ELSE 0 END AS level, line || CASE WHEN n = k THEN '' ELSE {_NL} END AS whole, {_TOKENS.format(x='line')} AS tokens FROM split),
 headed AS (SELECT *, coalesce(max(CASE WHEN level BETWEEN 1 AND 5 THEN n END) OVER (PARTITION BY doc_id ORDER BY n), 1) AS f, sum(length(whole)) OVER (PARTITION BY doc_id ORDER BY n) - length(whole) AS start FROM lined),
 sect0 AS (SELECT doc_id, f AS n, 0 AS p0, max(CASE WHEN level BETWEEN 1 AND 5 THEN level ELSE 0 END) AS level, max(CASE WHEN level BETWEEN 1 AND 5 THEN line END) AS line, min(start) AS start, sum(tokens) AS tokens, bool_and(level > 0 OR trim(line) = '') AS trivial, bool_and(trim(line) = '') AS blank, string_agg(whole, '' ORDER BY headed.n) AS content FROM headed GROUP BY doc_id, f),
 {', '.join(steps)},
 shaped AS (SELECT *, {began} AS begins, {keep} AS keep, [{', '.join(f'c{k} IS NOT NULL' for k in ks)}] AS q, [{', '.join(f'p{k}' for k in range(depth + 1))}] AS p FROM {last}),
 frag0 AS (SELECT doc_id, min(n) AS n, arg_min(begins, n) AS begins, arg_min(line, n) AS line, arg_min(keep, n) AS keep, arg_min(q, n) AS q, arg_min(p, n) AS p, min(start) AS start, sum(tokens) AS tokens, bool_and(trivial) AS trivial, bool_and(blank) AS blank, string_agg(content, '' ORDER BY n) AS content FROM shaped GROUP BY doc_id, p{depth}),
 frag AS (SELECT *, {path} AS path FROM frag0)"""


def chunks_sql(source: str, limit: int) -> str:
    """chunk: the text chunks of `source` (doc_id, text)."""
    return f"""{parts_sql(source, '{tokens} >= ' + str(limit))}, marked_frag AS (SELECT *, NOT blank AND (tokens >= {limit} OR NOT trivial) AS is_chunk FROM frag),
 near AS (SELECT *, lead(CASE WHEN is_chunk THEN {{'n': n, 'p': p}} END IGNORE NULLS) OVER w AS nx, lag(CASE WHEN is_chunk THEN {{'n': n, 'p': p}} END IGNORE NULLS) OVER w AS pv FROM marked_frag WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
 pend AS (SELECT doc_id, coalesce(nx.p[begins] = p[begins], false) AS ahead, CASE WHEN coalesce(nx.p[begins] = p[begins], false) THEN nx.n WHEN coalesce(pv.p[begins] = p[begins], false) THEN pv.n END AS goes, begins, n, line, start FROM near WHERE begins > 0 AND NOT is_chunk AND NOT coalesce(nx.p[begins + 1] = p[begins + 1], false)),
 pre AS (SELECT doc_id, goes, string_agg(line, {_NL} ORDER BY begins, ahead, n) AS prefix, min(CASE WHEN ahead THEN start END) AS a, max(CASE WHEN NOT ahead THEN start + length(line) END) AS z FROM pend WHERE goes IS NOT NULL GROUP BY 1, 2),
 chunk AS (SELECT c.doc_id, CAST(row_number() OVER (PARTITION BY c.doc_id ORDER BY c.n) AS INT) AS chunk_index, CASE WHEN tokens >= {limit} THEN 'Summary' ELSE 'Text' END AS type, tokens >= {limit} AS needs_summary, CAST(tokens + coalesce({_TOKENS.format(x='prefix')}, 0) AS BIGINT) AS tokens, path,
 coalesce(prefix || {_NL}, '') || content AS content, CAST(coalesce(a, start) AS BIGINT) AS "start", CAST(coalesce(z, start + length(content)) AS BIGINT) AS "end" FROM marked_frag c LEFT JOIN pre ON pre.doc_id = c.doc_id AND pre.goes = c.n WHERE is_chunk)"""


_OCR_DOCS = f"""{_OCR}, ocr_docs AS (SELECT doc_id, array_to_string(l, {_NL}) AS text FROM ocr)"""
_BOTH = f"""{_OCR_DOCS}, {_PLACED}, {_SPANS}, all_docs AS (SELECT doc_id, text FROM ocr_docs UNION ALL SELECT doc_id + 1000000000, text FROM paged), {chunks_sql('all_docs', LIMIT)},
 every AS (SELECT *, false AS t FROM chunk UNION ALL SELECT doc_id + 1000000000, CAST(segment AS INT), 'Table', false, CAST({_TOKENS.format(x='content')} AS BIGINT), '', content, CAST("start" AS BIGINT), CAST("end" AS BIGINT), true FROM tchunk),
 inner_one AS (SELECT *, NOT t AND EXISTS (SELECT 1 FROM tchunk x WHERE x.doc_id + 1000000000 = every.doc_id AND x."start" <= every."start" AND every."end" <= x."end") AS inside FROM every),
 isle AS (SELECT *, sum(CASE WHEN inside AND chunk_index > 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, t ORDER BY chunk_index) AS g FROM inner_one),
 one AS (SELECT doc_id, t, min(chunk_index) AS chunk_index, arg_min(type, chunk_index) AS type, arg_min(needs_summary, chunk_index) AS needs_summary, sum(tokens) AS tokens, arg_min(path, chunk_index) AS path, string_agg(content, {_NL} ORDER BY chunk_index) AS content, arg_min("start", chunk_index) AS "start", arg_min("end", chunk_index) AS "end" FROM isle GROUP BY doc_id, t, g),
 alone AS (SELECT *, NOT t AND len(list_filter(string_split(content, {_NL}), lambda x: NOT (trim(x) = '' OR regexp_matches(x, '^#{{1,6}}([ \\t]|$)')))) = 0 AS a, row_number() OVER (PARTITION BY doc_id, t ORDER BY chunk_index DESC) = 1 AS z FROM one),
 isle2 AS (SELECT *, sum(CASE WHEN NOT a OR z THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, t ORDER BY chunk_index DESC) AS g FROM alone),
 two AS (SELECT doc_id, t, max(chunk_index) AS i, arg_max(type, chunk_index) AS type, arg_max(needs_summary, chunk_index) AS needs_summary, sum(tokens) AS tokens, arg_max(path, chunk_index) AS path, string_agg(content, {_NL} ORDER BY chunk_index) AS content, arg_max("start", chunk_index) AS "start", arg_max("end", chunk_index) AS "end" FROM isle2 GROUP BY doc_id, t, g),
 three AS (SELECT doc_id, t, i, CASE WHEN NOT t AND (needs_summary OR tokens > {LIMIT}) THEN 'Summary' ELSE type END AS type, NOT t AND (needs_summary OR tokens > {LIMIT}) AS needs_summary, CAST(tokens AS BIGINT) AS tokens, path, content, "start", "end" FROM two),
 merged AS (SELECT doc_id, type, needs_summary, tokens, path, content, "start", "end", CAST(row_number() OVER (PARTITION BY doc_id, type ORDER BY i) AS INT) AS chunk_index, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY "start", t, i) AS INT) AS place FROM three)"""
_SECTIONS = f"""{_OCR_DOCS}, {parts_sql('ocr_docs', '{tokens} > ' + str(LIMIT))}, sections AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) AS INT) AS section, content, path, list_last(string_split(path, ' --> ')) AS title, CAST(tokens AS BIGINT) AS tokens FROM frag WHERE keep AND (NOT blank OR tokens > 0))"""


def mixed_lines(t) -> DataFrame:
    """ocr_document() with lines of all kinds: a list item, quote, rule, table, HTML block, fenced code and underlined title now and then."""
    put = lambda x, i: F.when(i % 29 == 4, F.concat(F.lit("- "), x)).when(i % 29 == 7, F.concat(F.lit("> "), x)).when(i % 29 == 10, F.lit("* * *")).when(i % 29 == 13, F.concat(F.lit("| a | b |\n|---|---|\n| 1 |"), x, F.lit("|\n"))).when(i % 29 == 16, F.concat(F.lit("<div>\n"), x, F.lit("\n"))).when(i % 29 == 19, F.lit("```\n# no heading\n```")).when(i % 29 == 22, F.lit("Title\n====")).otherwise(x)
    each = ocr_document(t).select("doc_id", F.split("text", "\n").alias("l"))
    return each.select("doc_id", F.array_join(F.transform("l", put), "\n").alias("text"))


@query(
    "k1_classify_lines",
    f"""WITH {_OCR}, put AS (SELECT doc_id, list_transform(l, lambda x, i: CASE (i - 1) % 29 WHEN 4 THEN '- ' || x WHEN 7 THEN '> ' || x WHEN 10 THEN '* * *' WHEN 13 THEN '| a | b |' || {_NL} || '|---|---|' || {_NL} || '| 1 |' || x || '|' || {_NL} WHEN 16 THEN '<div>' || {_NL} || x || {_NL} WHEN 19 THEN '```' || {_NL} || '# no heading' || {_NL} || '```' WHEN 22 THEN 'Title' || {_NL} || '====' ELSE x END) AS l FROM ocr),
    parts AS (SELECT doc_id, array_to_string(l, {_NL}) AS text FROM put), o AS (SELECT doc_id, unnest(string_split(text, {_NL})) AS line, generate_subscripts(string_split(text, {_NL}), 1) AS n FROM parts),
    f AS (SELECT *, sum(CASE WHEN line = '```' THEN 1 ELSE 0 END) OVER w AS fences FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
    c AS (SELECT *, line = '```' OR fences % 2 = 1 AS code FROM f), b AS (SELECT *, NOT code AND trim(line, ' ' || chr(9) || chr(13)) = '' AS blank, NOT code AND regexp_matches(line, '^ {{0,3}}<[A-Za-z/!?]') AS tag FROM c),
    h AS (SELECT *, NOT code AND NOT blank AND coalesce(max(CASE WHEN tag THEN n END) OVER w > coalesce(max(CASE WHEN blank THEN n END) OVER w, 0), false) AS html FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
    bar AS (SELECT *, NOT code AND NOT html AND contains(line, '|') AS bar FROM h),
    run AS (SELECT *, CASE WHEN bar AND NOT coalesce(lag(bar) OVER w, false) THEN coalesce(lead(bar AND line = '|---|---|') OVER w, false) END AS opens, lead(line) OVER w AS below FROM bar WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
    k AS (SELECT *, CASE WHEN code THEN 'code' WHEN blank THEN 'blank' WHEN html THEN 'html' WHEN bar AND last_value(opens IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) THEN 'table' WHEN regexp_matches(line, '^ {{0,3}}#{{1,6}}([ \t]|$)') THEN 'heading'
    WHEN regexp_matches(line, '^ {{0,3}}((-[ \t]*){{3,}}|(_[ \t]*){{3,}}|([*][ \t]*){{3,}})$') THEN 'rule' WHEN regexp_matches(line, '^ {{0,3}}([-*+]|[0-9]{{1,9}}[.)])([ \t]|$)') THEN 'list' WHEN regexp_matches(line, '^ {{0,3}}>') THEN 'quote' ELSE 'paragraph' END AS k0 FROM run),
    t AS (SELECT *, k0 = 'paragraph' AND coalesce(regexp_matches(below, '^ {{0,3}}(=+|-+)[ \t]*$'), false) AND NOT regexp_matches(line, '^ {{0,3}}(=+|-+)[ \t]*$') AS title FROM k),
    u AS (SELECT *, coalesce(lag(title) OVER (PARTITION BY doc_id ORDER BY n), false) AS under FROM t)
    SELECT doc_id, CAST(n AS INT) AS n, CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n) - length(line) - 1 AS BIGINT) AS "start", CASE WHEN title OR under THEN 'heading' ELSE k0 END AS kind,
    CAST(CASE WHEN title THEN CASE WHEN contains(below, '=') THEN 1 ELSE 2 END WHEN k0 = 'heading' THEN length(regexp_extract(trim(line), '^#+')) ELSE 0 END AS INT) AS level, CAST(len(regexp_extract_all(line, '[^ \t\n\r\f\v]+')) AS BIGINT) AS tokens FROM u""",
)
def _(t):
    return lines.classify_lines(mixed_lines(t)).select("doc_id", "n", "start", "kind", "level", "tokens")


@query("k2_text_chunks", f"WITH {_OCR_DOCS}, {chunks_sql('ocr_docs', LIMIT)} SELECT * FROM chunk")
def _(t):
    return chunking.text_chunks(ocr_document(t), LIMIT)


@query("e1_chunk_index", f"WITH {_OCR_DOCS}, {chunks_sql('ocr_docs', LIMIT)} SELECT doc_id, chunk_index, \"start\", tokens FROM chunk")
def _(t):
    return chunking.text_chunks(ocr_document(t), LIMIT).select("doc_id", "chunk_index", "start", "tokens")


@query(
    "e5_heading_path",
    f"""WITH {_OCR}, x AS (SELECT *, CASE WHEN regexp_matches(line, '^#{{1,6}}([ \\t]|$)') THEN length(regexp_extract(line, '^#+')) ELSE 0 END AS level FROM opened),
    a AS (SELECT *, max(CASE WHEN level = 1 THEN n END) OVER w AS a1, max(CASE WHEN level = 2 THEN n END) OVER w AS a2, max(CASE WHEN level = 3 THEN n END) OVER w AS a3 FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY n))
    SELECT a.doc_id, CAST(a.n AS INT) AS n, concat_ws(' --> ', h1.line, h2.line, h3.line) AS path FROM a LEFT JOIN opened h1 ON h1.doc_id = a.doc_id AND h1.n = a.a1
    LEFT JOIN opened h2 ON h2.doc_id = a.doc_id AND h2.n = a.a2 AND a.a2 > coalesce(a.a1, 0) LEFT JOIN opened h3 ON h3.doc_id = a.doc_id AND h3.n = a.a3 AND a.a3 > greatest(coalesce(a.a1, 0), coalesce(a.a2, 0))""",
)
def _(t):
    return lines.heading_path(lines.classify_lines(ocr_document(t))).select("doc_id", "n", "path")


@query("e8_table_title", f"WITH {_PLACED} SELECT doc_id, CAST(first_n + i AS INT) AS n, '## Section ' || table_index AS title FROM placed, range(0, 100) r(i) WHERE i <= k + 1")
def _(t):
    return tables.table_title(lines.classify_lines(table_document(t))).filter("kind = 'table'").select("doc_id", "n", "title")


@query("e9_table_segments", f"WITH RECURSIVE {_MD}, {_BY_CUSTOMER}, {fold_sql('cand', 'split')} SELECT doc_id, CAST(j AS INT) AS table_index, segment, round(list_min(scores), 4) AS min_score, round(list_max(scores), 4) AS max_score, method, merged FROM fold")
def _(t):
    return tables.table_segments(md_table(t))


@query(
    "k5_table_decisions",
    f"""WITH RECURSIVE {_MD}, {_BY_CUSTOMER}, {fold_sql('cand', 'merge')} SELECT doc_id, CAST(j AS INT) AS table_index, segment, array_to_string(list_transform(used, lambda r: r.j), ',') AS refs, CAST(len(scores) AS INT) AS n_scores,
    round(coalesce(list_sum(list_transform(scores, lambda x: round(x, 4))), 0.0), 3) AS total, round(list_min(scores), 4) AS min_score, round(list_max(scores), 4) AS max_score, method, merged FROM fold
    UNION ALL SELECT NULL, NULL, CAST(count(*) AS INT), NULL, NULL, NULL, NULL, NULL, method, merged FROM fold GROUP BY method, merged""",
)
def _(t):
    found = tables.table_decisions(md_table(t), "merge")
    total = F.round(F.aggregate("scores", F.lit(0.0), lambda a, x: a + x), 3)
    rows = found.select("doc_id", "table_index", "segment", F.array_join(F.col("refs").cast("array<string>"), ",").alias("refs"), F.size("scores").alias("n_scores"), total.alias("total"), "min_score", "max_score", "method", "merged")
    totals = tables.decision_totals(found).select(F.col("n").cast("int").alias("segment"), "method", "merged")
    return rows.unionByName(totals, allowMissingColumns=True).select(rows.columns)


@query("k3_table_chunks", f"WITH RECURSIVE {_PLACED}, {_SPANS} SELECT doc_id, segment AS table_index, '## Section ' || first AS title, '' AS path, CAST({_TOKENS.format(x='content')} AS BIGINT) AS tokens, content, CAST(\"start\" AS BIGINT) AS \"start\", CAST(\"end\" AS BIGINT) AS \"end\" FROM tchunk")
def _(t):
    return tables.document_table_chunks(table_document(t), "merge")


@query("d12_table_info", f"""WITH {_PLACED} SELECT doc_id, CAST(j AS INT) AS table_index, CAST("start" AS BIGINT) AS "start", CAST("start" + length(body) - 1 AS BIGINT) AS "end", CAST(first_n AS INT) AS first_n, CAST(first_n + k + 1 AS INT) AS last_n, CAST(len(h) AS INT) AS column_count,
 array_to_string(list_transform(h, lambda x: trim(x)), '|') AS header, true AS has_header, CAST(k AS INT) AS row_count FROM placed""")  # fmt: skip
def _(t):
    found = tables.tables_of(lines.classify_lines(table_document(t)))
    return found.withColumn("header", F.array_join("header_cells", "|")).drop("header_cells")


@query("h12_remove_tables", f"WITH {_PLACED} SELECT doc_id, regexp_replace(string_agg(front, {_NL} || {_NL} ORDER BY table_index), '\\s+$', '') AS text FROM placed GROUP BY 1")
def _(t):
    return tables.remove_tables(lines.classify_lines(table_document(t)))


def both_kinds(t) -> tuple[DataFrame, DataFrame]:
    """Text chunks and table chunks of documents and of documents full of tables."""
    docs = ocr_document(t).select(F.col("doc_id"), "text").unionByName(table_document(t).select((F.col("doc_id") + 10**9).alias("doc_id"), "text"))
    return chunking.text_chunks(docs, LIMIT), tables.document_table_chunks(docs, "merge")


def union_of(t) -> DataFrame:
    return chunking.union_chunks(*both_kinds(t))


def both(t) -> DataFrame:
    return chunking.merge_and_reindex(*both_kinds(t), LIMIT)


@query("k4_merge_and_reindex", f"WITH RECURSIVE {_BOTH} SELECT * FROM merged")
def _(t):
    return both(t)


@query("f9_chunks_by_position", f"WITH RECURSIVE {_BOTH} SELECT doc_id, place, type, \"start\" FROM merged")
def _(t):
    return both(t).select("doc_id", "place", "type", "start")


@query("e2_reindex_per_type", f"WITH RECURSIVE {_BOTH} SELECT doc_id, type, chunk_index, place FROM merged")
def _(t):
    return both(t).select("doc_id", "type", "chunk_index", "place")


@query("c5_chunks_inside_tables", f"WITH RECURSIVE {_PLACED}, {_SPANS}, {chunks_sql('paged', 8)} SELECT c.doc_id, chunk_index FROM chunk c WHERE EXISTS (SELECT 1 FROM tchunk x WHERE x.doc_id = c.doc_id AND x.\"start\" <= c.\"start\" AND c.\"end\" <= x.\"end\")")
def _(t):
    docs = table_document(t)
    return chunking.chunks_inside_tables(chunking.text_chunks(docs, 8), tables.document_table_chunks(docs, "merge"))


@query("e3_merge_inside_tables", f"""WITH RECURSIVE {_BOTH} SELECT doc_id, t AS is_table, chunk_index, CAST(tokens AS BIGINT) AS tokens, content FROM one""")
def _(t):
    return chunking.merge_inside_tables(union_of(t)).select("doc_id", "is_table", "chunk_index", "tokens", "content")


def headings_only(t) -> DataFrame:
    """Chunks in the shape of union_chunks(): the lines of documents, every other one a heading."""
    each = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    content = F.when(F.col("i") % 2 == 0, F.concat(F.lit("# "), "line")).otherwise(F.col("line"))
    return each.select("doc_id", (F.col("i") + 1).alias("chunk_index"), F.lit("Text").alias("type"), F.lit(False).alias("needs_summary"), F.lit(1).cast("long").alias("tokens"), F.lit("").alias("path"), content.alias("content"), F.col("i").cast("long").alias("start"), (F.col("i") + 1).cast("long").alias("end"), F.lit(False).alias("is_table"))


@query(
    "e4_merge_trivial_forward",
    f"""WITH x AS (SELECT doc_id, unnest(string_split(text, {_NL})) AS line, generate_subscripts(string_split(text, {_NL}), 1) AS n FROM documents), y AS (SELECT doc_id, n, CASE WHEN n % 2 = 1 THEN '# ' ELSE '' END || line AS content FROM x),
    a AS (SELECT *, n % 2 = 1 OR trim(content) = '' AS alone, n = max(n) OVER (PARTITION BY doc_id) AS z FROM y), g AS (SELECT *, sum(CASE WHEN NOT alone OR z THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n DESC) AS g FROM a)
    SELECT doc_id, CAST(max(n) AS INT) AS chunk_index, count(*) AS tokens, string_agg(content, {_NL} ORDER BY n) AS content FROM g GROUP BY doc_id, g""",
)
def _(t):
    return chunking.merge_trivial_forward(headings_only(t)).select("doc_id", "chunk_index", "tokens", "content")


@query("g2_union_chunks", f"WITH RECURSIVE {_BOTH} SELECT doc_id, type, content FROM every")
def _(t):
    return union_of(t).select("doc_id", "type", "content")


@query(
    "d10_chunk_type_counts",
    f"""WITH RECURSIVE {_BOTH} SELECT doc_id, count(*) FILTER (type = 'Text') AS n_text, count(*) FILTER (type = 'Table') AS n_table, count(*) FILTER (type = 'Summary') AS n_summary, CAST(sum(tokens) AS BIGINT) AS n_tokens FROM merged GROUP BY ROLLUP (doc_id)""",
)
def _(t):
    return chunking.chunk_type_counts(both(t))


@query("k6_summary_sections", f"WITH {_SECTIONS} SELECT * FROM sections")
def _(t):
    return chunking.summary_sections(ocr_document(t), LIMIT)


@query(
    "k7_top_level_sections",
    f"""WITH {_OCR}, x AS (SELECT *, regexp_matches(line, '^#[ \\t]') AS head FROM opened), s AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS section, n = max(n) OVER (PARTITION BY doc_id) AS is_last FROM x)
    SELECT doc_id, CAST(section AS INT) AS section, string_agg(line || CASE WHEN is_last THEN '' ELSE chr(10) END, '' ORDER BY n) AS content, min(CASE WHEN head THEN line END) AS title, min(CASE WHEN head THEN line END) AS path FROM s WHERE section > 0 GROUP BY 1, 2""",
)
def _(t):
    return chunking.top_level_sections(ocr_document(t)).withColumn("section", F.col("section").cast("int"))


@query(
    "d11_page_image_totals",
    """WITH p AS (SELECT doc_id, ceil(len(string_split(text, chr(10))) / 6.0) AS k FROM documents) SELECT doc_id, CAST(k AS BIGINT) AS n_pages, CAST(k AS BIGINT) AS n_images FROM p""",
)
def _(t):
    from docfoundry.sources.files import page_image_totals

    return page_image_totals(ocr_page(t))


@query("h3_dice", f"WITH p AS (SELECT a.p_partkey AS id, a.p_name AS x, b.p_name AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1) SELECT id, round({dice_sql('x', 'y')}, 4) AS dice FROM p")
def _(t):
    p = t.part.join(t.part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("y")), "p_partkey")
    return p.select(F.col("p_partkey").alias("id"), F.round(tables.dice(F.col("p_name"), F.col("y")), 4).alias("dice"))


_CELLS = """p AS (SELECT a.p_partkey AS id, lower(trim(a.p_type)) AS x, lower(trim(CASE WHEN b.p_partkey % 7 = 0 THEN '' WHEN b.p_partkey % 5 = 0 THEN substring(b.p_type, 1, 4) WHEN b.p_partkey % 3 = 0 THEN substring(a.p_type, 2, 50) || 'x' ELSE b.p_type END)) AS y
 FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)"""


@query("h4_cell_similarity", f"WITH {_CELLS} SELECT id, CAST({_CELL} AS DOUBLE) AS similarity FROM p")
def _(t):
    other = t.part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_type").alias("t2"), F.col("p_partkey").alias("k2"))
    p = t.part.join(other, "p_partkey")
    y = F.expr("case when k2 % 7 = 0 then '' when k2 % 5 = 0 then substring(t2, 1, 4) when k2 % 3 = 0 then concat(substring(p_type, 2, 50), 'x') else t2 end")
    return p.select(F.col("p_partkey").alias("id"), tables.cell_similarity(F.col("p_type"), y).alias("similarity"))


@query("h6_column_similarity", "SELECT p_partkey AS id, CAST(CASE WHEN p_size % 5 = p_size % 4 THEN 1.0 WHEN abs(p_size % 5 - p_size % 4) = 1 THEN 0.4 ELSE 0.0 END AS DOUBLE) AS similarity FROM part")
def _(t):
    return t.part.select(F.col("p_partkey").alias("id"), tables.column_similarity(F.col("p_size") % 5, F.col("p_size") % 4).alias("similarity"))


@query("h5_h7_table_similarity", f"""WITH {_MD}, {_SIMILAR}, p AS (SELECT a.cust AS doc_id, a.table_index, a.has_header AS x, b.has_header AS y, s, CASE WHEN len(a.h) = len(b.h) THEN 1.0 WHEN abs(len(a.h) - len(b.h)) = 1 THEN 0.4 ELSE 0.0 END AS c
 FROM md a JOIN md b ON b.cust = a.cust AND b.table_index = a.table_index + 1 JOIN sim ON sim.a = array_to_string(a.h, '|') AND sim.b = array_to_string(b.h, '|'))
 SELECT doc_id, CAST(table_index AS INT) AS table_index, round(s, 4) AS header, round(CASE WHEN x AND y THEN 0.8 * s + 0.2 * c WHEN x THEN 0.7 + 0.2 * c WHEN y THEN 0.1 + 0.2 * c ELSE 0.5 + 0.4 * c END, 4) AS score FROM p""")
def _(t):
    m = md_table(t)
    info = F.struct("column_count", "header_cells", "has_header")
    one = m.select("doc_id", "table_index", info.alias("t1"))
    two = m.select("doc_id", (F.col("table_index") - 1).alias("table_index"), info.alias("t2"))
    scored = one.join(two, ["doc_id", "table_index"])
    return scored.select("doc_id", "table_index", F.round(tables.header_similarity(F.col("t1.header_cells"), F.col("t2.header_cells")), 4).alias("header"), F.round(tables.table_similarity(F.col("t1"), F.col("t2")), 4).alias("score"))


@query("h8_continuation_decision", "SELECT p_partkey AS id, CASE WHEN p_size / 100.0 >= 0.70 THEN true WHEN p_size / 50.0 <= 0.25 THEN false END AS continues FROM part")
def _(t):
    return t.part.select(F.col("p_partkey").alias("id"), tables.continuation_decision(F.col("p_size") / 100.0, F.col("p_size") / 50.0).alias("continues"))


@query("h11_html_table_info", f"""SELECT doc_id, CAST(3 AS INT) AS column_count, lang || '|' || source || '|Note' AS header, CAST(len(string_split(text, {_NL})) AS INT) AS row_count FROM documents""")
def _(t):
    """A table of each document: its lines as rows, each with a table in a cell."""
    row = lambda x: F.concat(F.lit("<tr><td>"), F.translate(x, "<>", "()"), F.lit("</td><td><table><tr><th>n</th><td>1</td><td>2</td><td>3</td></tr></table></td><TD x='1'>c</TD></tr>"))
    head = F.concat(F.lit("<table class='t'><tr><th>"), "lang", F.lit("</th><th> "), "source", F.lit(" </th><th>Note</th></tr>"))
    html = F.concat(head, F.array_join(F.transform(F.split("text", "\n"), row), ""), F.lit("</table>"))
    info = t.documents.select("doc_id", tables.html_table_info(html).alias("i"))
    return info.select("doc_id", "i.column_count", F.array_join("i.header_cells", "|").alias("header"), "i.row_count")


@query("h10_strip_nested_tables", "SELECT doc_id, '<table>' || text || lang || '</table><table>f</table>' AS html FROM documents")
def _(t):
    html = F.concat(F.lit("a<TABLE x='1'>"), "text", F.lit("<table><tr>"), "source", F.lit("</tr></table>"), "lang", F.lit("</table>e<table>f</table>g"))
    return t.documents.select("doc_id", tables.strip_nested_tables(html).alias("html"))


@query("h25_is_trivial", f"""WITH x AS (SELECT doc_id, list_filter(string_split(text, {_NL}), lambda x: NOT (trim(x) = '' OR regexp_matches(x, '^ {{0,3}}#{{1,6}}([ \\t]|$)') OR regexp_matches(x, '^ {{0,3}}((-[ \\t]*){{3,}}|(_[ \\t]*){{3,}}|([*][ \\t]*){{3,}})$'))) AS l FROM documents)
 SELECT doc_id, true AS headed, true AS in_html, len(l) = 0 AS plain FROM x""")  # fmt: skip
def _(t):
    lines_of = lambda f: F.array_join(F.transform(F.split("text", "\n"), f), "\n")
    headed = lines_of(lambda x: F.concat(F.lit("## "), x))
    in_html = F.concat(F.lit("<div>\n"), lines_of(lambda x: F.when(F.trim(x) == "", "-").otherwise(x)), F.lit("\n\n---\n# b"))
    return t.documents.select("doc_id", *(chunking.is_trivial(c).alias(k) for k, c in {"headed": headed, "in_html": in_html, "plain": F.col("text")}.items()))


@query("e10_line_state", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
 SELECT doc_id, CAST(n AS INT) AS n, n % 5 = 0 OR (n // 5) % 2 = 1 AS is_code FROM l""")  # fmt: skip
def _(t):
    fenced = F.transform(F.split("text", "\n"), lambda x, i: F.when((i + 1) % 5 == 0, "```").otherwise(x))
    found = lines.classify_lines(t.documents.select("doc_id", F.array_join(fenced, "\n").alias("text")))
    return found.select("doc_id", "n", (F.col("kind") == "code").alias("is_code"))


_LOADED = ("nation", "documents", "lineitem", "conversations")


@query("a4_load_tables", " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in _LOADED))
def _(t):
    from docfoundry.sources.files import load_tables

    found = load_tables(t.spark, t.sf_dir, list(_LOADED))
    counts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, df in found.items()]
    return reduce(DataFrame.unionByName, counts)


@query("a5_list_objects", "SELECT name AS key, true AS has_size FROM (VALUES ('region'), ('nation'), ('customer'), ('supplier'), ('part'), ('orders'), ('lineitem'), ('events'), ('benchmark')) v(name)")
def _(t):
    """The tables that are one file each, as objects of a store."""
    from docfoundry.sources.files import list_objects

    found = list_objects(t.spark, t.sf_dir).select(F.regexp_extract("key", r"/([a-z]+)\.parquet$", 1).alias("key"), (F.col("size") > 0).alias("has_size"))
    return found.filter(~F.col("key").isin("", "documents", "embeddings", "pages", "labels", "conversations"))


def quarter(text):
    """A counter that doesn't add up over lines: a quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / 4)


# in SQL characters add up, so limits are theirs: of n tokens or more has a text of 4 * n - 3 characters or more
_LENGTHS = (_TOKENS.format(x="line"), "length(whole)")
_QUARTER = "CAST(ceil(length(content) / 4.0) AS BIGINT) AS tokens"


@query("k2_recounted_chunks", f'WITH {_OCR_DOCS}, {chunks_sql("ocr_docs", 4 * LIMIT - 3).replace(*_LENGTHS)} SELECT doc_id, chunk_index, type, needs_summary, {_QUARTER}, path, content, "start", "end" FROM chunk')
def _(t):
    return chunking.text_chunks(ocr_document(t), LIMIT, counter=quarter)


@query("k6_recounted_sections", f"""WITH {_OCR_DOCS}, {parts_sql("ocr_docs", "{tokens} > " + str(4 * LIMIT)).replace(*_LENGTHS)} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) AS INT) AS section, content, path, {_QUARTER} FROM frag WHERE keep AND NOT blank""")
def _(t):
    return chunking.summary_sections(ocr_document(t), LIMIT, counter=quarter).drop("title")

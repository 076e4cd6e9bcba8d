"""The corpus tables that the operators expect, derived from the given tables by one SQL text that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

STATUSES = "Uploading Uploaded Failed Succeeded ProcessingOcr ProcessingGenQa ProcessingIndexing ProcessingMetadata Canceled".split()
JOB_STATUSES = "None Succeeded Failed Canceled Processing Pending".split()


def pick(expression: str, values: list[str]) -> str:
    return f"CASE {expression} {' '.join(f'WHEN {i} THEN {chr(39)}{v}{chr(39)}' for i, v in enumerate(values))} END"


_YEAR, _MONTH = "CAST(year(o_orderdate) AS STRING)", "lpad(CAST(month(o_orderdate) AS STRING), 2, '0')"

#: name: (tables or other fixtures it reads, SQL)
FIXTURES: dict[str, tuple[tuple[str, ...], str]] = {
    "dataset": (
        ("customer",),
        """SELECT c_custkey AS id, c_name AS name, c_custkey % 50 AS owner_user_id,
        CASE WHEN c_nationkey % 6 = 5 THEN NULL ELSE c_nationkey % 6 END AS department_id, c_mktsegment AS template_id,
        c_acctbal < -500 AS is_deleted, (c_custkey * 7919) % 100000 AS updated_at FROM {customer}""",
    ),
    "document": (
        ("orders",),
        f"""SELECT o_orderkey AS id, o_custkey AS dataset_id, concat('file', CAST(o_orderkey % 700 AS STRING), '.pdf') AS file_name,
        {pick('o_orderkey % 9', STATUSES)} AS status, o_orderkey % 4 <> 0 AS is_ocred, o_orderkey % 3 = 0 AS is_indexed,
        CAST(floor(o_totalprice * 100) AS BIGINT) AS file_size, o_orderdate AS created_at, o_orderdate + INTERVAL '1' DAY * CAST(o_orderkey % 30 AS INT) AS updated_at,
        o_orderkey % 17 = 0 AS is_deleted,
        CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE concat('content of ', CAST(o_orderkey AS STRING)) END AS ocr_content,
        CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('summary of ', CAST(o_orderkey AS STRING)) END AS summary,
        CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat('qa of ', CAST(o_orderkey AS STRING)) END AS qa_summary FROM {{orders}}""",
    ),
    "document_job": (
        ("orders",),
        f"""SELECT o_orderkey AS document_id, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE {pick('o_orderkey % 6', JOB_STATUSES)} END AS status_ocr,
        {pick('CAST(floor(o_orderkey / 6) AS BIGINT) % 6', JOB_STATUSES)} AS status_indexing FROM {{orders}}""",
    ),
    "dataset_item": (
        ("orders",),
        f"""SELECT DISTINCT o_custkey * 1000000 + year(o_orderdate) * 100 AS id, o_custkey AS dataset_id, concat('y', {_YEAR}) AS name, 'Folder' AS item_type,
        concat('/y', {_YEAR}, '/') AS path, 0 AS level, CAST(NULL AS BIGINT) AS parent_id, CAST(NULL AS BIGINT) AS document_id, year(o_orderdate) % 10 AS sort_order,
        (o_custkey + year(o_orderdate)) % 7 = 0 AS is_deleted FROM {{orders}}
        UNION ALL SELECT DISTINCT o_custkey * 1000000 + year(o_orderdate) * 100 + month(o_orderdate), o_custkey, concat('m', {_MONTH}), 'Folder',
        concat('/y', {_YEAR}, '/m', {_MONTH}, '/'), 1, o_custkey * 1000000 + year(o_orderdate) * 100, NULL, month(o_orderdate) % 10, false FROM {{orders}}
        UNION ALL SELECT 1000000000000 + o_orderkey, o_custkey, concat('d', CAST(o_orderkey AS STRING)), 'Document',
        concat('/y', {_YEAR}, '/m', {_MONTH}, '/d', CAST(o_orderkey AS STRING), '/'), 2, o_custkey * 1000000 + year(o_orderdate) * 100 + month(o_orderdate), o_orderkey,
        CAST(o_orderkey % 100 AS INT), o_orderkey % 19 = 0 FROM {{orders}}""",
    ),
    "access_share": (
        ("lineitem", "orders"),
        """SELECT o_custkey AS dataset_id, CASE WHEN l_linenumber = 3 THEN 1000000000000 + o_orderkey ELSE NULL END AS dataset_item_id,
        CASE WHEN l_linenumber % 2 = 1 THEN l_suppkey % 50 ELSE NULL END AS user_id, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_suppkey % 6 AS INT) ELSE NULL END AS department_id,
        CAST(1 + l_partkey % 15 AS INT) AS mask FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    ),
    "user_department": (
        ("customer",),
        """SELECT DISTINCT c_custkey % 50 AS user_id, CAST(c_custkey % 50 % 6 AS INT) AS department_id, true AS is_primary,
        CASE WHEN c_custkey % 50 % 3 = 0 THEN 'Manager' ELSE 'Staff' END AS role FROM {customer}
        UNION ALL SELECT DISTINCT c_custkey % 50, CAST((c_custkey % 50 + 1) % 6 AS INT), false, 'Staff' FROM {customer}""",
    ),
    "object": (
        ("orders", "pages"),
        """SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'ocr' ELSE 'document' END AS bucket,
        CASE WHEN o_orderkey % 2 = 0 THEN upper(concat('in/file', CAST(o_orderkey AS STRING), '.pdf')) ELSE concat('in/file', CAST(o_orderkey AS STRING), '.pdf') END AS key,
        CAST(floor(o_totalprice * 100) AS BIGINT) + CASE WHEN o_orderkey % 23 = 0 THEN 1 ELSE 0 END AS size, o_orderdate AS modified FROM {orders} WHERE o_orderkey % 13 <> 0
        UNION ALL SELECT 'document', url, page_id, TIMESTAMP '1999-01-01 00:00:00' FROM {pages}""",
    ),
    "document_key": (
        ("document",),
        """SELECT id, CASE WHEN id % 2 = 0 THEN concat('in/file', CAST(id AS STRING), '.pdf') ELSE concat('File', CAST(id AS STRING), '.PDF') END AS object_key, status, file_size, is_deleted, created_at FROM {document}""",
    ),
    "name_corpus": (("part",), "SELECT p_partkey AS id, concat(p_name, ' ', p_brand, ' ', p_type) AS name, p_partkey % 40 + 1 AS dataset_id FROM {part}"),
    "name_query": (("part",), "SELECT p_partkey AS query_id, CASE WHEN p_partkey % 100 = 0 THEN p_name ELSE substring(p_name, 2, 100) END AS text, CAST(floor(p_partkey / 50) AS BIGINT) % 50 AS user_id FROM {part} WHERE p_partkey % 50 = 0"),
    "point": (
        ("embeddings",),
        """SELECT vec_id AS point_id, CAST(floor(vec_id / 4) AS BIGINT) AS document_id, label AS dataset_id, embedding AS vector,
        CASE vec_id % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'table' ELSE 'summary' END AS chunk_type, concat('chunk ', CAST(vec_id AS STRING)) AS content,
        CASE WHEN vec_id % 3 = 2 THEN concat('full ', CAST(vec_id AS STRING)) ELSE NULL END AS content_full,
        CASE vec_id % 4 WHEN 0 THEN 'report' WHEN 1 THEN 'memo' ELSE 'letter' END AS document_type, 2000 + vec_id % 25 AS year, (vec_id % 100) / 100.0 AS score_value, vec_id % 2 = 0 AS flag FROM {embeddings}""",
    ),
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in FIXTURES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    needs, sql = FIXTURES[name]
    return spark.sql(sql, **{n: fixture(spark, sf_dir, n) for n in needs})


def with_fixtures(names: tuple[str, ...], sql: str) -> str:
    """The SQL with each fixture that it needs, and those that they need, as a common table expression before it."""
    done: list[str] = []

    def add(name: str) -> None:
        if name in FIXTURES and name not in done:
            for n in FIXTURES[name][0]:
                add(n)
            done.append(name)

    for n in names:
        add(n)
    parts = [f"{n} AS ({FIXTURES[n][1].format(**{x: x for x in FIXTURES[n][0]})})" for n in done]
    recursive = sql.lstrip().upper().startswith("WITH RECURSIVE")
    body = sql.strip()
    if body.upper().startswith("WITH"):
        body = body[len("WITH RECURSIVE") if recursive else len("WITH") :]
        return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join([*parts, body])}" if parts else sql
    return f"WITH {', '.join(parts)} {body}" if parts else body

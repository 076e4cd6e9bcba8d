"""One query for each operator of this subpackage, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_pairs, jaccard_join, licences, mixing, pieces, quality_qda, quality_rules, spelling, surrogates, training_order, url_filter, vector_codes, vector_forest
from .common import table


def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.training_order(table(spark, sf_dir, "documents"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labelled = docs.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    return mixing.mix(docs, labelled.select("doc_id", F.col("lang").alias("domain")))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_qda.quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_vector_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_forest.vector_duplicates(table(spark, sf_dir, "embeddings"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"))


def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.pii(table(spark, sf_dir, "documents"), check=True)


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_scan(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.document_variants(table(spark, sf_dir, "documents"))


def op12_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_pairs.digests(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_training_order,
        op2_jaccard_join,
        op3_mixing,
        op4_quality_classifier,
        op5_vector_forest,
        op6_quality_rules,
        op7_url_filter,
        op8_sentencepiece,
        op9_surrogates,
        op10_licence_scan,
        op11_spelling_variants,
        op12_byte_pairs,
        op13_vector_codes,
    )
}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _jaccard_sql() -> str:
    return rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)),
    c(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT c.x, l.y FROM c JOIN l ON l.x = c.y)
    SELECT x AS doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(y) AS component_id FROM c LEFT JOIN n ON n.doc_id = x GROUP BY x"""


def _vector_sql() -> str:
    return """WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM e a JOIN e b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
    c(x, y) AS (SELECT vec_id, vec_id FROM e UNION SELECT c.x, l.y FROM c JOIN l ON l.x = c.y),
    n AS (SELECT x, count(*) AS n FROM l GROUP BY 1)
    SELECT c.x AS vec_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_links, min(c.y) AS component_id, c.x = min(c.y) AS kept FROM c LEFT JOIN n ON n.x = c.x GROUP BY c.x"""


def _licence_sql() -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    places, shares = [], []
    for phrase, label in licences.PHRASES:
        here = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split()))
        places.append(f"SELECT doc_id, '{label}' AS label, unnest(list_filter(range(1, len(w) + 1), lambda i: {here})) - 1 AS i FROM t")
    for label, text in licences.TEMPLATES:
        own = ", ".join(f"'{w}'" for w in sorted(set(text.split())))
        shares.append(f"SELECT doc_id, '{label}' AS label, len(list_intersect(l, [{own}])) / {len(set(text.split()))} AS share FROM lines")
    return f"""WITH t AS (SELECT doc_id, {_LOWER} AS x, regexp_extract_all({_LOWER}, '{word}') AS w FROM documents), base AS ({" UNION ALL ".join(places)}),
    lines AS (SELECT doc_id, list_distinct(regexp_extract_all(unnest(string_split(x, chr(10))), '{word}')) AS l FROM t),
    met AS (SELECT * FROM ({" UNION ALL ".join(shares)}) x WHERE share >= 0.8),
    b AS (SELECT doc_id, count(*) AS n, min(i) AS f, max(i) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY 1),
    a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM base UNION SELECT doc_id, label FROM met) x GROUP BY 1),
    m AS (SELECT doc_id, max(share) AS share FROM met GROUP BY 1)
    SELECT t.doc_id, CAST(len(t.w) AS BIGINT) AS n_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_base, CAST(b.f AS BIGINT) AS first_word, CAST(b.z AS BIGINT) AS last_word, coalesce(b.labels, '') AS base_labels,
    coalesce(a.labels, '') AS labels, CAST(CASE WHEN b.n > 0 THEN 1.0 ELSE coalesce(m.share, 0.0) END AS DOUBLE) AS score FROM t LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id) LEFT JOIN m USING (doc_id)"""


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Every entry is compared with every part here; nothing is left out by sums."""
    steps, dist = [], "CAST(list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    nearest = f"SELECT p.vec_id, p.k, arg_min(c.j, ({dist}, c.j)) AS j, min({dist}) AS d FROM p JOIN c{{r}} c ON c.k = p.k GROUP BY p.vec_id, p.k"
    for r in range(rounds):
        steps.append(f"a{r} AS ({nearest.format(r=r)})")
        steps.append(f"s{r} AS (SELECT k, j, i, sum(x) AS s, count(*) AS n FROM (SELECT a.k, a.j, unnest(range(1, len(p.v) + 1)) AS i, unnest(p.v) AS x FROM a{r} a JOIN p ON p.vec_id = a.vec_id AND p.k = a.k) y GROUP BY ALL)")
        steps.append(f"m{r} AS (SELECT k, j, list(CAST((s - ((s % n + n) % n)) // n AS BIGINT) ORDER BY i) AS v FROM s{r} GROUP BY ALL)")
        steps.append(f"c{r + 1} AS (SELECT c.k, c.j, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m ON m.k = c.k AND m.j = c.j)")
    return f"""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    p AS MATERIALIZED (SELECT vec_id, k, v[k * len(v) // {parts} + 1 : (k + 1) * len(v) // {parts}] AS v FROM e CROSS JOIN range({parts}) r(k)),
    c0 AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY vec_id) - 1 AS j, v FROM p WHERE vec_id IN (SELECT vec_id FROM e ORDER BY vec_id LIMIT {entries})),
    {", ".join(x.replace(" AS (", " AS MATERIALIZED (", 1) for x in steps)}, z AS ({nearest.format(r=rounds)}),
    o AS (SELECT e.vec_id, e.label, string_agg(lpad(lower(to_hex(z.j)), 2, '0'), '' ORDER BY z.k) AS code, CAST(sum(z.d) AS BIGINT) AS error FROM e JOIN z ON z.vec_id = e.vec_id GROUP BY ALL),
    h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY k, j)) AS h FROM c{rounds})
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM o CROSS JOIN h"""


#: op1, op3, op4, op6, op7, op8, op9 and op12 rest on ciphers, trained models or a tokenizer, op11 on a checksum, which SQL doesn't have: tests
#: hold them to brute force.
ORACLES: dict[str, str] = {"op2_jaccard_join": _jaccard_sql(), "op5_vector_forest": _vector_sql(), "op10_licence_scan": _licence_sql(), "op13_vector_codes": _codes_sql()}

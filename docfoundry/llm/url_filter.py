"""URL filters: host and path rules, and for what no rule reaches a logistic regression on hashed character n-grams.

Built-in functions only, training included.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rules as (host, start of the path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case, and path without query or fragment; both empty for a null url or one without `://`."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """A struct (size, rule, verdict) of the longest rule that fits, or null. Of rules as long, the later in text order wins."""
    fits = [
        F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for h, p, v in rules
    ]
    return F.array_max(F.array_compact(F.array(*fits)))


def grams(host: Column, path: Column, size: int, n: tuple[int, ...] = (3, 4)) -> Column:
    """The distinct buckets, 0 to size - 1, of the character n-grams of host and path, each marked as its part's."""

    def part(tag: str, text: Column) -> list[Column]:
        marked = F.concat(F.lit("^"), text, F.lit("$"))
        none = F.array().cast("array<int>")
        return [F.when(F.length(marked) >= k, F.transform(F.sequence(F.lit(1), F.length(marked) - (k - 1)), bucket(tag, marked, k))).otherwise(none) for k in n]

    def bucket(tag: str, marked: Column, k: int):
        return lambda i: F.pmod(F.xxhash64(F.lit(tag), marked.substr(i, F.lit(k))), F.lit(size)).cast("int")

    return F.array_distinct(F.concat(*part("h", host), *part("p", path)))


@dataclass(frozen=True)
class Weights:
    by_bucket: list[float]
    intercept: float


def train(labelled: DataFrame, size: int = 1024, rows: int = 2000) -> Weights:
    """Fit on at most `rows` rows (host, path, block 0/1), those with the smallest hash. One class only: its constant verdict."""
    few = labelled.orderBy(F.xxhash64("host", "path"), "host", "path", "block").limit(rows)
    f = HashingTF(inputCol="grams", outputCol="features", numFeatures=1 << 16, binary=True)
    data = f.transform(few.select(F.col("block").cast("double").alias("label"), grams(F.col("host"), F.col("path"), size).cast("array<string>").alias("grams"))).persist()
    share = data.agg(F.avg("label"), F.count("*")).first()
    if not share[1] or share[0] in (0.0, 1.0):
        data.unpersist()
        return Weights([0.0] * size, -20.0 if not share[0] else 20.0)
    model = LogisticRegression(maxIter=40, regParam=0.005).fit(data)
    data.unpersist()
    found = model.coefficients.toArray()  # one fetch, not one for each bucket
    return Weights([float(found[f.indexOf(str(i))]) for i in range(size)], float(model.intercept))


def block_score(host: Column, path: Column, w: Weights) -> Column:
    """The probability, 0 to 1, that an url is to be blocked."""
    table = F.from_json(F.lit(str(w.by_bucket)), "array<double>")
    z = F.aggregate(grams(host, path, len(w.by_bucket)), F.lit(w.intercept), lambda acc, g: acc + F.get(table, g))
    return 1 / (1 + F.exp(-z))


def url_filter(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, labelled: DataFrame | None = None, threshold: float = 0.5, rows: int = 2000) -> DataFrame:
    """page_id, host, path, rule (null where none fits), verdict and score of every page, one row for each row.

    labelled (host, path, block) trains the model; without it, the pages that a rule reaches do, other than those with
    crc32(page_id) mod 5 = 0. A null url has an empty host and path, like one without `://`; the model judges it. A null page_id stays
    null; repeated rows are judged alike; urls are taken whole. Extra columns, whatever their names, are not read; an empty table gives
    none back.
    """
    rules = RULES if rules is None else rules
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    ruled = parts.withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules))
    if labelled is None:
        held = F.coalesce(F.crc32(F.col("page_id").cast("string")) % 5 == 0, F.lit(False))
        labelled = ruled.filter(F.col("_rule").isNotNull() & ~held).select("host", "path", (F.col("_rule.verdict") == "block").cast("int").alias("block"))
    scored = ruled.withColumn("score", block_score(F.col("host"), F.col("path"), train(labelled, rows=rows)))
    judged = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", judged).alias("verdict"), "score")

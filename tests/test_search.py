"""Vector search against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docfoundry.operators import search
from docfoundry.plans.registry import Tables


def best(asked, points, may, k, threshold):
    """{request: [(point, score)]} by brute force."""
    norm = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    ids, owner = np.array([p[0] for p in points]), np.array([p[2] for p in points])
    s = norm(np.array([p[1] for p in points], float)) @ norm(np.array([v for _, v in asked], float)).T
    out = {}
    for j, (r, _) in enumerate(asked):
        order = [i for i in np.lexsort((ids, -s[:, j])) if s[i, j] >= threshold and may(r, owner[i])][:k]
        out[r] = [(int(ids[i]), round(float(s[i, j]), 6)) for i in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["request_id"], r["rank"])):
        out.setdefault(r["request_id"], []).append((r["point_id"], round(r["score"], 6)))
        assert r["rank"] == len(out[r["request_id"]])
    return out


def test_any_number_of_requests(spark):
    rng = np.random.default_rng(7)
    asked = [(i, rng.normal(size=8).tolist()) for i in range(2500)]
    points = [(i, rng.normal(size=8).tolist(), i % 5) for i in range(900)]
    q = spark.createDataFrame(asked, "request_id long, vector array<double>")
    p = spark.createDataFrame([(i, i // 3, v, d) for i, v, d in points], "point_id long, document_id long, vector array<double>, dataset_id int")
    want = best(asked, points, lambda r, d: True, 4, 0.3)
    assert found(search.vector_top_k(q, p, k=4)) == {r: x for r, x in want.items() if x}
    allowed = q.select("request_id", F.explode(F.array(*(F.lit(d) for d in range(5)))).alias("dataset_id")).filter("(request_id + dataset_id) % 3 = 0")
    want = best(asked, points, lambda r, d: (r + d) % 3 == 0, 4, 0.3)
    assert found(search.vector_top_k(q, p, k=4, allowed=allowed, block=100)) == {r: x for r, x in want.items() if x}
    assert search.vector_top_k(q.limit(0), p).count() == search.vector_top_k(q, p.limit(0)).count() == 0


def test_every_fiftieth_vector_is_asked(spark):
    t = Tables(spark, "/root/testdata/sf0.1")
    q = t.embeddings.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("request_id"), F.col("embedding").alias("vector"))
    got = found(search.vector_top_k(q, t.point, block=10))
    asked = [(r["request_id"], r["vector"]) for r in q.collect()]
    want = best(asked, [(r["point_id"], r["vector"], 0) for r in t.point.collect()], lambda r, d: True, 10, 0.3)
    assert len(want) == 40 and {r: [s for _, s in x] for r, x in got.items()} == {r: [s for _, s in x] for r, x in want.items()}


def test_vectors_that_cannot_be_compared(spark):
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [1.0], [nan, 0.0], [inf, 0.0], [None, 1.0], [0.0, 0.0]]
    ask = spark.createDataFrame([(1, [1.0, 0.0]), *((10 + i, v) for i, v in enumerate(odd))], "request_id long, vector array<double>")
    have = spark.createDataFrame([(1, 1, [2.0, 0.1]), *((20 + i, 2, v) for i, v in enumerate(odd))], "point_id long, document_id long, vector array<double>")
    got = search.vector_top_k(ask, have).select("request_id", "point_id").collect()
    assert sorted(map(tuple, got)) == [(1, 1), (12, 22)]


def test_a_request_for_a_forbidden_dataset_gets_nothing(spark):
    asked = spark.createDataFrame([(1, 7), (2, 7), (3, 8), (4, 9)], "request_id long, user_id long")
    wanted = spark.createDataFrame([(1, 100), (2, 100), (2, 300)], "request_id long, dataset_id long")
    accessible = spark.createDataFrame([(7, 100), (7, 200), (8, 300)], "user_id long, dataset_id long")
    assert sorted(map(tuple, search.granted(asked, wanted, accessible).collect())) == [(1, 100), (3, 300)]


def test_conditions_on_payloads(spark):
    p = spark.createDataFrame([(1, 0.5, ["a", "b"]), (2, 0.25, []), (3, None, None)], "id long, x double, tags array<string>")
    ids = lambda c: [r["id"] for r in p.filter(search.metadata_filter(c, ("tags",))).collect()]
    assert ids({"x": 0.5}) == [1] and ids({"tags": "b"}) == [1] and ids({"x": (None, 0.3)}) == [2] and ids({}) == [1, 2, 3]


def test_points_stay_where_they_are(spark, tmp_path):
    from docfoundry.operators.points import read_points, replace_points

    rng = np.random.default_rng(11)
    asked = [(i, rng.normal(size=6).tolist()) for i in range(300)] + [(1000 + i, rng.normal(size=9).tolist()) for i in range(20)]
    rows = [(i, None if i % 50 == 0 else i // 3, rng.normal(size=9 if i % 4 == 0 else 6).tolist(), i % 7) for i in range(3000)]
    q = spark.createDataFrame(asked, "request_id long, vector array<float>")
    p = spark.createDataFrame(rows, "point_id long, document_id long, vector array<float>, dataset_id int").repartition(6)
    allowed = q.select("request_id", F.explode(F.array(F.lit(1), F.lit(4), F.lit(9))).alias("dataset_id")).filter("(request_id + dataset_id) % 3 <> 0")
    every = lambda df: sorted((r["request_id"], r["rank"], r["point_id"], r["document_id"] is None or r["document_id"], round(r["score"], 9)) for r in df.collect())
    for grants in (None, allowed):
        for kind in search.DISTANCES:
            options = {"k": 5, "threshold": -9.0, "distance": kind, "allowed": grants}
            near, far = search.vector_top_k(q, p, **options), search.vector_top_k(q, p, most=0, block=50, **options)
            assert every(near) == every(far) and near.count() > 300
    plan = search.vector_top_k(q, p, allowed=allowed)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "CoGroup" not in plan
    # of stored points only the granted datasets' files are read, and no vector is shuffled
    replace_points(p.filter("document_id is not null"), str(tmp_path / "points"), 1)
    stored = read_points(spark, str(tmp_path / "points"))
    top = search.vector_top_k(q, stored, allowed=allowed, k=3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.split("\n") if "FileScan parquet" in line and "vector" in line)
    assert "dataset_id" in scan.split("PartitionFilters: [", 1)[1].split("PushedFilters")[0] and " IN (1,4,9)" in scan
    assert not any("vector" in line for line in plan.split("\n") if "Exchange" in line)
    assert every(top) == every(search.vector_top_k(q, p.filter("document_id is not null"), allowed=allowed, k=3))


def py_grams(text):
    import re

    return {f"  {w} "[i : i + 3] for w in re.findall(r"[^\W_]+", (text or "").lower()) for i in range(len(w) + 1)}


def names_at_random(seed, n):
    import random

    r = random.Random(seed)
    words = ["steel", "Steel plate", "copper", "tin", "brushed", "a", "x1", "été", "small", "smell", "polished", "standard", "50%", "under_score"]
    return [" ".join(r.choice(words) for _ in range(r.choice([0, 1, 2, 3, 5, 9, 30]))) for _ in range(n)]


@pytest.mark.parametrize("least, crowd", [(0.3, 20_000), (0.3, 3), (0.7, 5), (1.0, 5), (1e-9, 7)])
def test_trigram_join_loses_no_pair(spark, least, crowd):
    have, ask = names_at_random(1, 250), names_at_random(2, 60)
    n = spark.createDataFrame([*enumerate(have), (999, None)], "id long, name string").repartition(5)
    q = spark.createDataFrame([*enumerate(ask), (999, None)], "query_id long, text string")
    want = {}
    for i, a in enumerate(ask):
        for j, b in enumerate(have):
            x, y = py_grams(a), py_grams(b)
            s = len(x & y) / len(x | y) if x | y else 0
            if s >= least and s > 0:
                want[i, j] = round(s, 9)
    got = search.trigram_join(q, n, least, crowd).collect()
    assert {(r["query_id"], r["id"]): round(r["similarity"], 9) for r in got} == want and len(got) == len(want)


def test_no_pair_is_shuffled_where_most_are_found(spark, monkeypatch):
    """Each block of queries meets each of names; texts of many rows are in several parts, similarities rounded half up."""
    from decimal import ROUND_HALF_UP, Decimal

    for k, v in {"OWNERS": 3, "TEXTS": (20, 7), "MOST_OWNERS": 50, "_ROWS": 16, "_ASKERS": 2}.items():
        monkeypatch.setattr(search, k, v)
    have, ask = names_at_random(1, 40) * 6 + names_at_random(4, 60), [*names_at_random(2, 30), *["steel tin"] * 9, "", "##"]
    n = spark.createDataFrame([*((i // 2, x) for i, x in enumerate(have)), (None, "steel"), (999, None)], "id long, name string").repartition(3)
    q = spark.createDataFrame([*((f"q{i}", x) for i, x in enumerate(ask)), (None, "steel"), ("q999", None)], "query_id string, text string")
    want = []
    for i, a in enumerate(ask):
        for j, b in enumerate(have):
            x, y = py_grams(a), py_grams(b)
            if x & y:
                want.append((f"q{i}", j // 2, float(Decimal(repr(len(x & y) / len(x | y))).quantize(Decimal("0.1"), ROUND_HALF_UP))))
    found = search.trigram_join(q, n, 1e-9, digits=1)
    assert sorted(map(tuple, found.collect())) == sorted(want) and any(s == 0.1 for _, _, s in want)
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    above = plan.split("CartesianProduct")[0]
    assert "MapInArrow" in above and "Join" not in plan and "Exchange" not in above
    none = search.trigram_join(q.limit(0), n, 1e-9), search.trigram_join(q, n.limit(0), 1e-9)
    assert [df.count() for df in none] == [0, 0]


@pytest.mark.parametrize("crowd", [20_000, 2])
def test_holding_with_wildcards_and_short_texts(spark, crowd):
    import re

    have = [*names_at_random(3, 200), "a\\b", "50% off"]
    ask = ["steel", "STEEL p", "pl_te", "st%br", "a", "", "%", "el_", "50%", "tin tin", "zzz", "été", "%ass%", "under_score"]
    n = spark.createDataFrame([*enumerate(have), (999, None)], "id long, name string").repartition(5)
    q = spark.createDataFrame([*enumerate(ask), (999, None)], "query_id long, text string")
    as_pattern = lambda t: re.compile("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in t.lower()), re.S)
    want = {(i, j) for i, t in enumerate(ask) for j, x in enumerate(have) if as_pattern(t).search(x.lower())}
    assert {(r["query_id"], r["id"]) for r in search.holding(q, n, crowd).collect()} == want


def test_crowded_trigrams_are_joined_in_groups(spark):
    n = spark.range(4000).select("id", F.concat(F.lit("common "), F.col("id").cast("string")).alias("name"))
    q = spark.createDataFrame([(1, "common 17")], "query_id long, text string")
    often = search._Frequency(n.select(search.trigrams(F.col("name")).alias("g")), 500)
    rows = often.dealt(n.select("id", F.lit("com").alias("t")), "t", "id").groupBy("_group").count().collect()
    assert len(rows) >= 8 and max(r["count"] for r in rows) < 1000
    assert often.every(q.withColumn("t", F.lit("com")), "t").count() == len(rows)
    assert (1, 17) in {(r["query_id"], r["id"]) for r in search.trigram_join(q, n, crowd=500).collect()}


def test_few_datasets_have_points(spark, monkeypatch):
    """Grants of datasets without points aren't collected, and don't count among what tasks may be handed."""
    rng = np.random.default_rng(5)
    asked = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(20)], "request_id long, vector array<double>")
    points = spark.createDataFrame([(i, i, rng.normal(size=4).tolist(), i % 3) for i in range(90)], "point_id long, document_id long, vector array<double>, dataset_id int")
    allowed = asked.select("request_id", F.explode(F.sequence(F.lit(1), F.lit(5000))).alias("dataset_id"))
    most = 20 * (8 * 4 + 16)
    got = []
    bounded = search._bounded_grants
    monkeypatch.setattr(search, "_bounded_grants", lambda *a: got.append(bounded(*a)) or got[-1])
    top = search.vector_top_k(asked, points, k=5, threshold=-9.0, allowed=allowed.unionByName(allowed), most=most)
    assert "CoGroup" not in top._jdf.queryExecution().executedPlan().toString()
    assert {d: who.tolist() for d, who in got[0].items()} == {1: list(range(20)), 2: list(range(20))}
    vectors = {r["request_id"]: r["vector"] for r in asked.collect()}
    want = best(list(vectors.items()), [(r["point_id"], r["vector"], r["dataset_id"]) for r in points.collect()], lambda r, d: d in (1, 2), 5, -9.0)
    assert found(top) == want


@pytest.mark.parametrize("limited", [False, True])
def test_texts_of_many_rows_are_compared_once(spark, limited):
    """Copies, in other cases too, find and are found each on their own, in the order of their ids among equals."""
    import re

    have = [(i, x.upper() if i % 3 else x, i % 4) for i, x in enumerate(names_at_random(8, 40) * 12)] + [(900, None, 1), (None, "steel", 1)]
    ask = [(i, x if i % 2 else x.title()) for i, x in enumerate(names_at_random(9, 12) * 3)] + [(99, None)]
    n = spark.createDataFrame(have, "id long, name string, dataset_id int").repartition(4)
    q = spark.createDataFrame(ask, "query_id long, text string")
    assert search.distinct_texts(n, "name").count() == len({x.lower() for _, x, _ in have if x is not None})
    may = {(i, d) for i, _ in ask for d in range(4) if (i + d) % 3}
    allowed = spark.createDataFrame(sorted(may), "request_id long, dataset_id int") if limited else None
    pattern = lambda t: re.compile("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in t.lower()), re.S)
    want = set()
    for i, a in ask:
        rows = []
        for j, b, d in have:
            if a is None or b is None or j is None or limited and (i, d) not in may:
                continue
            x, y = py_grams(a), py_grams(b)
            s = len(x & y) / len(x | y) if x | y else 0.0
            if s >= 0.3 or pattern(a).search(b.lower()):
                rows.append((-round(s, 9), j))
        want |= {(i, j, k + 1) for k, (_, j) in enumerate(sorted(rows)[:20])}
    assert {tuple(r) for r in search.name_search(q, n, allowed=allowed).select("query_id", "id", "rank").collect()} == want


def test_grants_of_datasets_that_hold_anything(spark):
    asked = spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "request_id long, user_id long")
    wanted = spark.createDataFrame([(1, 100), (2, 300)], "request_id long, dataset_id long")
    accessible = spark.createDataFrame([(7, 100), (8, 300), (8, 400), (9, 400)], "user_id long, dataset_id long")
    holding = spark.createDataFrame([(400,), (400,), (None,)], "dataset_id int")
    assert sorted(map(tuple, search.granted(asked, wanted, accessible, holding).collect())) == [(1, 100), (3, 400)]

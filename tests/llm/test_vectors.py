"""Vector near duplicates against brute force."""

import numpy as np
import pytest

from docfoundry.llm import common, vector_forest
from tests.llm.test_pairs import roots


def brute(ids, x, threshold=0.9):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    pairs = [(a, b) for a, b in zip(*np.nonzero(near)) if a < b]
    return near.sum(1), [ids[r] for r in roots(len(ids), pairs)]


def clustered(seed, n=4000, dim=64):
    """Pairs around the threshold, groups, and exact copies."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 4, dim))
    at = rng.integers(0, len(base), n)
    at[:300] = 5
    x = base[at] + rng.normal(size=(n, dim)) * rng.choice([0.1, 0.3, 0.33, 0.4], (n, 1))
    x[100:200] = x[100]
    return x.astype(np.float32)


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(7)


def test_links_are_exact_and_found(spark):
    x = clustered(1)
    want, component = brute(list(range(len(x))), x.astype(float))
    for leaf in (10**6, 200):
        got = sorted(vector_forest.vector_duplicates(frame(spark, x), leaf=leaf, block=150 if leaf > len(x) else 300).collect())
        n = np.array([r["n_links"] for r in got])
        assert (n <= want).all()
        if leaf > len(x):
            assert (n == want).all() and [r["component_id"] for r in got] == component
        assert n.sum() >= 0.97 * want.sum()
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize("dim", [64, 384, 1024])
def test_recall_at_default_settings(spark, dim):
    """Pairs from just over the threshold upwards; the leaf's size is the default one."""
    n = 12_000 if dim < 1000 else 8_000
    x = clustered(dim, n, dim)
    assert vector_forest.plan(n, 3000, 0.9, 0.15, 0.97)[0] >= 2
    want, _ = brute(list(range(n)), x.astype(float))
    got = sorted(vector_forest.vector_duplicates(frame(spark, x)).collect())
    found = np.array([r["n_links"] for r in got])
    assert (found <= want).all() and want.sum() > n and found.sum() >= 0.9 * want.sum()


def test_deep_trees_leave_few_copies():
    for dim in (64, 1024):
        x = np.random.default_rng(dim).normal(size=(4000, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        row, leaf = vector_forest.grow(x, 6, 0.15, np.random.default_rng(1)).leaves(x)
        assert len(row) < 2.2 * len(x) and np.bincount(leaf).max() < 4 * len(x) / 64


def test_given_vectors(spark):
    v = common.table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = v.orderBy("vec_id").collect()
    want, component = brute([r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], float))
    got = sorted(vector_forest.vector_duplicates(v).collect())
    assert [r["n_links"] for r in got] == want.tolist() and [r["component_id"] for r in got] == component


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, []), (8, [1.0, None]), (None, [1.0, 0.0]), (9, [1.0]), (10, [1.0, 0.0]), (11, [1e38, 1e38]), (12, [-1.0, 0.0])]
    got = {r["vec_id"]: tuple(r)[1:] for r in vector_forest.vector_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == {None: (0, None, True), 1: (2, 1, True), 2: (2, 1, False), 10: (2, 1, False)} | {i: (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 11, 12)}
    assert vector_forest.vector_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0

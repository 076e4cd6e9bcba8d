"""Similarity joins against brute force."""

import random
import re

import numpy as np
import pytest

from docfoundry.llm import common, graph, jaccard_join

SF = "/root/testdata/sf0.01"


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(i) for i in range(n)]


def shingle_sets(texts, n=5):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    return out


def brute(texts):
    sets, held, links = shingle_sets(texts), {}, []
    for i, s in enumerate(sets):
        near = {}
        for x in s:
            for j in held.get(x, ()):
                near[j] = near.get(j, 0) + 1
            held.setdefault(x, []).append(i)
        links += [(j, i) for j, both in near.items() if 100 * both >= 75 * (len(s) + len(sets[j]) - both)]
    return [len(s) for s in sets], roots(len(texts), links)


def hard_texts(seed, n):
    """Groups of copies with changes around the threshold, chains, shared passages, short texts, repeats."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5)))
    passage = [word() for _ in range(60)]
    texts = ["", None, " \n", "One", "one", "a b c d", "A b c d", "a b c d e", "x " * 3000]
    while len(texts) < n:
        base = [word() for _ in range(rng.choice([3, 6, 8, 12, 30, 60, 120, 300, 1200]))]
        if rng.random() < 0.5:
            base[len(base) // 2 : len(base) // 2] = passage
        for _ in range(rng.choice([1, 1, 2, 5, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, len(base) // 40, len(base) // 30, len(base) // 20])):
                at = rng.randrange(len(copy))
                copy[at : at + rng.choice([0, 1, 1])] = [word()]
            if rng.random() < 0.3:
                base = copy
            texts.append(rng.choice([" ", "\n", "\t "]).join(copy))
    return texts[:n]


def joined(spark, texts):
    rows = [(i, t, 0) for i, t in enumerate(texts)]
    return {r["doc_id"]: r for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string, n_shingles int").repartition(5)).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join(spark, seed):
    texts = hard_texts(seed, 700)
    sizes, want = brute(texts)
    got = joined(spark, texts)
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert len(set(want)) < 0.8 * len(texts)


def test_jaccard_join_of_documents(spark):
    docs = common.table(spark, SF, "documents")
    rows = sorted(docs.select("doc_id", "text").collect())
    sizes, want = brute([r["text"] for r in rows])
    got = {r["doc_id"]: r for r in jaccard_join.jaccard_join(docs).collect()}
    for r, n, c in zip(rows, sizes, want):
        assert (got[r["doc_id"]]["n_shingles"], got[r["doc_id"]]["component_id"]) == (n, rows[c]["doc_id"])


def test_words_that_very_many_sets_hold(spark):
    """One passage of most texts, and a group of near copies larger than a task's limit for a hot word."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    passage, base = [word() for _ in range(55)], [word() for _ in range(80)]
    texts = [" ".join(passage + [word() for _ in range(rng.choice([14, 20, 90]))]) for _ in range(250)]
    for _ in range(250):
        copy = list(base)
        copy[rng.randrange(80)] = word()
        texts.append(" ".join(copy))
    _, want = brute(texts)
    got = joined(spark, texts)
    assert [got[i]["component_id"] for i in range(len(texts))] == want


def test_jaccard_join_edges(spark):
    schema = "doc_id long, text string"
    assert jaccard_join.jaccard_join(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (7, None), (9, "a b c d e f"), (None, None), (3, "p q r s t u"), (3, "z y x w v u")]
    got = sorted(tuple(r) for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, schema)).collect() if r[0] is not None)
    assert got == [(3, 1 + 1, 3), (3, 1 + 1, 3), (5, 2, 5), (5, 2, 5), (7, 0, 7), (9, 2, 5)]
    kept = jaccard_join.keep_first(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r[0] or 0, r[1] or "") for r in kept) == [(0, ""), (0, "a b c d e f"), (3, "p q r s t u"), (3, "z y x w v u"), (5, "a b c d e f"), (7, "")]


def test_sketch_distance_bounds_the_difference():
    rng = np.random.default_rng(5)
    bands = jaccard_join.Bands(75, 100)
    for size in (5, 70, 300, 3000):
        h = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2))
        other = np.unique(np.concatenate([h[size // 9 :], rng.integers(0, 1 << 63, size // 9).astype(np.uint64)]))
        band = size.bit_length() - 1
        a, b = set(bands.sketch(h, band).tolist()), set(bands.sketch(other, band).tolist())
        difference = len(np.setxor1d(h, other))
        assert len(a - b) <= difference and len(b - a) <= difference


def test_components(spark):
    rng = random.Random(7)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 200)] + [(rng.randrange(400, 600), rng.randrange(400, 600)) for _ in range(120)]
    got = dict(tuple(r) for r in graph.components(spark.createDataFrame(links, "a long, b long"), common.Scratch(spark)).collect())
    want = roots(700, links)
    assert got == {x: want[x] for p in links if p[0] != p[1] for x in p}

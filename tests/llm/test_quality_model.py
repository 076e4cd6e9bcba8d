"""op4 as a whole query, against the same classifier written plainly: counts in Python, densities by solving."""

import math
import re
import zlib
from collections import Counter

import numpy as np
from docfoundry.llm import common, queries
from docfoundry.llm.quality_rules import platt

SF = "/root/testdata/sf0.01"
SYMBOLS, PUNCT = b"#*$%&|<>", b".,;:?\"'()"


def odds(x):
    return math.log((x + 1e-3) / (1 - min(x, 1) + 1e-3))


def plain_statistics(text):
    b = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0d]+", b)
    k, n, size = len(words), max(len(words), 1), max(len(b), 1)
    lengths = [len(w.decode()) for w in words]
    mean = sum(lengths) / n
    sd = math.sqrt(max(sum(x * x for x in lengths) / n - mean * mean, 0))
    windows = Counter(tuple(words[i : i + 8]) for i in range(k - 7))
    repeated = {i + j for i in range(k - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(8)}
    seen, dup = set(), 0
    for line in b.split(b"\n"):
        if re.search(rb"[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    share = lambda of: odds(sum(c in of for c in b) / size)
    lines = b.count(b"\n") + 1
    pairs = list(zip(words, words[1:]))
    upper = bytes(range(65, 91))
    return [
        math.log1p(k), math.log1p(mean), math.log1p(sd), share(upper), share(SYMBOLS), share(b"|"), share(b"!"), share(b"0123456789"), share(PUNCT), share(bytes(range(128, 256))),
        odds(len(set(words)) / n), odds(max(Counter(words).values(), default=0) / n), odds(len(repeated) / n), odds(dup / lines), math.log1p(n / lines),
        odds(sum(w[0] in upper for w in words) / n), odds(sum(x <= 3 for x in lengths) / n), odds(len(set(pairs)) / max(n - 1, 1)), odds(sum(x == y for x, y in pairs) / max(n - 1, 1)), odds(sum(w[-1] in SYMBOLS for w in words) / n),
    ]


def log_density(z, mean, cov):
    d = z - mean
    return np.array([-0.5 * (row @ np.linalg.solve(cov, row) + np.linalg.slogdet(cov)[1]) for row in d])


def test_op4_whole_query(spark):
    docs = {r["doc_id"]: r["text"] for r in common.table(spark, SF, "documents").select("doc_id", "text").collect()}
    x = {i: plain_statistics(t) for i, t in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in docs}
    labels = {r["doc_id"]: r["quality"] for r in common.table(spark, SF, "labels").collect() if r["doc_id"] in docs and not held[r["doc_id"]]}
    assert 100 < len(labels) <= 8000
    ids = sorted(labels)
    a, y = np.array([x[i] for i in ids]), np.array([labels[i] for i in ids], float)
    centre, scale = a.mean(0), np.maximum(a.std(0), 1e-3)
    z = lambda rows: np.clip((rows - centre) / scale, -8, 8)
    own = [np.cov(z(a)[y == c].T, bias=True) for c in (0, 1)]
    pooled = sum((y == c).mean() * own[c] for c in (0, 1))
    drawn = [0.9 * s + 0.1 * pooled for s in own]
    covs = [0.98 * s + 0.02 * np.trace(s) / len(s) * np.eye(len(s)) for s in drawn]
    means = [z(a)[y == c].mean(0) for c in (0, 1)]
    gap = lambda rows: np.arcsinh(log_density(z(rows), means[1], covs[1]) - log_density(z(rows), means[0], covs[0]))
    slope, offset = platt(gap(a), y)
    every = sorted(docs)
    want = 1 / (1 + np.exp(-np.clip(slope * gap(np.array([x[i] for i in every])) + offset, -30, 30)))
    got = {r["doc_id"]: r for r in queries.op4_quality_classifier(spark, SF).collect()}
    assert len(got) == len(docs)
    for i, s in zip(every, want):
        assert got[i]["held_out"] == held[i] and abs(got[i]["score"] - s) < 1e-6
        assert got[i]["predicted"] == int(got[i]["score"] >= 0.3)

"""Token counters that don't add up over lines: parts are counted on their own texts."""

import base64
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docfoundry.operators import chunking, lines
from tests import test_structure as model
from tests.test_structure import docs, texts  # noqa: F401

quarter = lambda text: F.ceil(F.length(text) / 4)


def subwords(name="byte_bpe_50k.tiktoken"):
    """(column function, plain function) that count byte pairs."""
    tokenizers = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = tokenizers.path(name), tokenizers.PATTERN

    def load():
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    held = []

    @F.pandas_udf("long")
    def count(text: pd.Series) -> pd.Series:
        if not held:
            held.append(load())
        return text.map(lambda t: len(held[0].encode_ordinary(t or "")))

    own = load()
    return count, lambda t: len(own.encode_ordinary(t))


def counters(kind):
    return (quarter, lambda t: math.ceil(len(t) / 4)) if kind == "quarter" else subwords()


@pytest.mark.parametrize("kind, limit", [("quarter", 3), ("quarter", 11), ("quarter", 40), ("subwords", 9), ("subwords", 30)])
def test_chunks_equal_direct_recursion(docs, texts, monkeypatch, kind, limit):  # noqa: F811
    counter, plain = counters(kind)
    monkeypatch.setattr(model, "tokens", plain)
    got = {}
    for r in chunking.text_chunks(docs, limit, counter=counter).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r["doc_id"], []).append([r["content"], r["tokens"], r["needs_summary"], r["path"], r["start"], r["end"]])
    for i, t in enumerate(texts):
        assert got.get(i, []) == [[c, n, s, " --> ".join(p), a, b] for c, n, s, p, a, b in model.model_chunks(t, limit)], repr(t)


@pytest.mark.parametrize("kind, limit", [("quarter", 6), ("subwords", 15)])
def test_sections_equal_direct_recursion(docs, texts, monkeypatch, kind, limit):  # noqa: F811
    counter, plain = counters(kind)
    monkeypatch.setattr(model, "tokens", plain)
    got = {}
    for r in chunking.summary_sections(docs, limit, counter=counter).orderBy("doc_id", "section").collect():
        assert r["tokens"] == plain(r["content"])
        got.setdefault(r["doc_id"], []).append((r["content"], r["path"]))
    for i, t in enumerate(texts):
        assert got.get(i, []) == [(c, " --> ".join(p)) for c, p in model.model_sections(t, limit) if c.strip()], repr(t)


def test_the_summing_and_the_counting_way_agree_where_both_are_right(docs):  # noqa: F811
    counted = lambda text: lines.count_tokens(text)
    assert chunking.adds_up(lines.count_tokens) and not chunking.adds_up(counted)
    for limit in (5, 12):
        a, b = (sorted(map(tuple, chunking.text_chunks(docs, limit, counter=c).collect())) for c in (lines.count_tokens, counted))
        assert a == b and a


def test_two_parts_that_round_up(spark):
    # whole lines of 20 characters: a part of four lines has 21 tokens, not the 24 of its lines
    body = "\n".join(["x" * 19] * 4)
    d = spark.createDataFrame([(1, f"# a\n{body}\n# b\n{body}")], "doc_id long, text string")
    got = [(r["tokens"], r["type"], r["needs_summary"]) for r in chunking.text_chunks(d, 30, counter=quarter).collect()]
    assert got == [(21, "Text", False), (21, "Text", False)]


def test_only_changed_parts_are_counted_again(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def noted(text):
        if text is not None:
            seen.add(len(text))
        return None if text is None else len(text)

    text = "\n".join(f"# t{k}\n" + "w " * 30 for k in range(20))
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert chunking.text_chunks(d, 200, counter=lambda c: noted(c)).count() == 20
    assert seen.value <= 3 * len(text)

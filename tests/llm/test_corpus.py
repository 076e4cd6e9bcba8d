"""Training order and mixing against plain models of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docfoundry.llm import common, mixing, training_order
from tests.llm.test_narrow import ODD

SF = "/root/testdata/sf0.01"


def test_encoder_is_the_librarys():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    e = training_order.Encoder.at(training_order.vocabulary_path())
    same = lambda t: np.frombuffer(e.encode(t), e.kind).tolist() == e.model.encode_ordinary(t)
    assert all(same(t) for t in ODD if t)

    @settings(max_examples=800, deadline=None)
    @given(st.text(st.sampled_from(" \n\t\r\x0b\x1c\x1f\x85\xa0 　᠎﻿abE'st1é日.!<|\U0001f600"), max_size=30))
    def check(t):
        assert same(t)

    check()


def test_permutation():
    for size in (1, 2, 3, 5, 64, 65, 1000, 4097):
        p = training_order.Permutation(size, "k")
        x = np.arange(size)
        assert sorted(p(x)) == list(x) and (p(p(x), back=True) == x).all()
    assert (training_order.Permutation(1000, "k")(np.arange(1000)) != training_order.Permutation(1000, "l")(np.arange(1000))).mean() > 0.9


def test_training_order(spark, tmp_path):
    docs = common.table(spark, SF, "documents").select("doc_id", "text").union(spark.createDataFrame([(10**9 + i, t) for i, t in enumerate(ODD)] + [(None, "x y")], "doc_id long, text string"))
    length, per_shard = 64, 500
    ordered = training_order.training_order(docs.withColumn("slot", F.lit(1)), "k", length, per_shard)
    rows = sorted(ordered.collect(), key=lambda r: r["sequence"])
    size = len(rows)
    assert [r["sequence"] for r in rows] == list(range(size)) and sorted(r["slot"] for r in rows) == list(range(size))
    assert [r["slot"] for r in rows] == training_order.Permutation(size, "k")(np.arange(size)).tolist()
    assert all((r["shard"], r["byte_offset"]) == (r["slot"] // per_shard, r["slot"] % per_shard * (2 * length + 1)) and len(r["record"]) == 2 * length for r in rows)
    stream = np.concatenate([np.frombuffer(r["record"], "<u2")[: r["n_tokens"]] for r in rows])
    e = training_order.Encoder.at(training_order.vocabulary_path())
    cuts = np.flatnonzero(stream == e.end)
    got = sorted(tuple(x) for x in np.split(stream, cuts + 1)[:-1])
    assert got == sorted((*e.model.encode_ordinary(r["text"] or ""), e.end) for r in docs.collect())
    ids = [i for r in rows for i in r["doc_ids"]]
    assert set(ids) == {r["doc_id"] for r in docs.collect()}
    training_order.write_shards(ordered, str(tmp_path / "out"))
    files = sorted((tmp_path / "out").glob("shard=*/part-*"))
    assert len(files) == -(-size // per_shard) and sum(f.stat().st_size for f in files) == size * (2 * length + 1)
    by_slot = {r["slot"]: bytes(r["record"]) for r in rows}
    again = training_order.read_slots(spark, str(tmp_path / "out"), per_shard - 3, 9, length, per_shard).collect()
    assert {r["slot"]: bytes(r["record"]) for r in again} == {s: by_slot[s] for s in range(per_shard - 3, per_shard + 6)}
    assert training_order.read_slots(spark, str(tmp_path / "out"), size + 10 * per_shard, 5, length, per_shard).count() == 0
    one = training_order.read_slots(spark, str(tmp_path / "out"), 0, 1, length, per_shard).select(training_order.ids_of(F.col("record")).alias("ids")).first()
    assert one["ids"] == np.frombuffer(by_slot[0], "<u2").tolist()


def test_shards_do_not_depend_on_splits(spark, tmp_path):
    common.table(spark, SF, "documents").repartition(5).write.parquet(str(tmp_path / "docs"))
    found = []
    for size in ("128m", "60k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        docs = spark.read.parquet(str(tmp_path / "docs"))
        found.append((docs.rdd.getNumPartitions(), {r["slot"]: bytes(r["record"]) for r in training_order.training_order(docs, length=64, per_shard=500).collect()}))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found[0][0] < found[1][0] and found[0][1] == found[1][1]


def test_training_order_without_rows(spark):
    assert training_order.training_order(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def labelled(docs):
    return docs.select("doc_id", F.col("lang").alias("domain"))


def test_mix_meets_targets(spark):
    docs = common.table(spark, SF, "documents")
    targets = {"en": 0.3, "de": 0.3, "fr": 0.2, "es": 0.2}
    got = mixing.mix(docs, labelled(docs), targets=targets).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    p = np.array(got.posteriors.tolist())
    names = list(got.domains[0])
    total = got.n_tokens.sum()
    have = (got.n_tokens.values * got.rate.values) @ p / total
    assert np.abs(have - [targets[k] for k in names]).max() <= 1e-4 and (got.rate >= 0).all()
    assert got.converged.all() and np.allclose(got.achieved[0], have, atol=1e-9) and np.allclose(got.targets[0], [targets[k] for k in names])
    big = got.n_tokens >= 20
    assert (np.array(names)[p.argmax(1)] == got.lang)[big].mean() > 0.97
    assert abs((got.copies - got.rate).mean()) < 0.08 and ((got.copies - got.rate).abs() < 1).all()
    # the rates are those of a plain projected gradient descent with all of them in memory
    v = got.n_tokens.values / total
    inverse = np.linalg.inv(p.T @ (p * v[:, None]))
    want = np.array([targets[k] for k in names])
    r = np.ones(len(v))
    for _ in range(60):
        e = (v * r) @ p - want
        if np.abs(e).max() <= 1e-4:
            break
        r = np.maximum(0, r - p @ (inverse @ e))
    assert np.allclose(r, got.rate.values, atol=1e-6)


def test_mix_says_when_targets_are_out_of_reach(spark):
    docs = common.table(spark, SF, "documents").filter("lang in ('en', 'de')")
    with pytest.warns(UserWarning, match="from the targets"):
        got = mixing.mix(docs, labelled(docs), targets={"en": 1.0}).first()
    assert not got["converged"] and got["achieved"][got["domains"].index("en")] > 0.95


def test_rates_need_few_passes(spark):
    docs = common.table(spark, SF, "documents")
    _, _, rates = mixing.fit(docs, labelled(docs))
    assert rates.converged and len(rates.steps) <= 15


def test_mix_edges(spark):
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(ODD)] + [(None, "a b", None, None)], "doc_id long, text string, _rate string, _copies int").withColumn("d", F.lit(1)).withColumn("r", F.lit(2))
    none = spark.createDataFrame([], "doc_id long, domain string")
    got = mixing.mix(docs, none).collect()
    assert len(got) == len(ODD) + 1 and all(r["rate"] == 1 and r["copies"] == 1 for r in got)
    assert sorted(map(str, mixing.apply_mix(docs, none).collect())) == sorted(map(str, docs.collect()))
    assert mixing.mix(docs.limit(0), none).count() == 0

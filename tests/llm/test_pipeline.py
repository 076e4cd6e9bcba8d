"""The pipeline, stage by stage, on what each was given."""

from pyspark.sql import functions as F

import corpus_pipeline
from docfoundry.llm import common, jaccard_join, quality_rules, surrogates

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = common.table(spark, SF, "documents").withColumn("doc_id", F.when(F.col("doc_id") == 7, None).otherwise(F.col("doc_id")))
    columns = docs.columns
    given = {}
    for name, stage in corpus_pipeline.STAGES:
        given[name] = docs
        docs = common.materialise(stage(spark, docs, SF), "stage")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    ids = lambda n: {r[0] for r in given[n].select("doc_id").collect()}
    first = quality_rules.quality_rules(given[names[0]], common.table(spark, SF, "labels"))
    assert ids(names[1]) == {r[0] for r in first.filter("kept").select("doc_id").collect()}
    groups = jaccard_join.jaccard_join(given[names[1]])
    assert ids(names[2]) == {r[0] for r in groups.filter("component_id is null or doc_id = component_id").select("doc_id").collect()}
    assert ids(names[3]) == ids(names[2]) and given[names[3]].count() == given[names[2]].count()
    found = surrogates.pii(given[names[2]])
    assert found.count() == given[names[3]].count() and surrogates.collisions(found).count() == 0
    assert ids(names[4]) <= ids(names[3])
    assert docs.count() == given[names[4]].count() and {"doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"} == set(docs.columns)


def test_stages_on_odd_rows_and_nothing(spark):
    good = " ".join(f"word{i} of the house on the hill" for i in range(12))
    rows = [(1, None), (2, ""), (3, good), (3, good), (None, good), (4, good + " and more"), (5, "x")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0 if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for empty in (False, True):
        for name, stage in corpus_pipeline.STAGES:
            given = docs.limit(0) if empty else docs
            out = common.materialise(stage(spark, given, SF), "odd")
            assert not empty or out.count() == 0, name
            if not empty and name == "n-gram Jaccard join":
                assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect()) == sorted([(0, good), (1, ""), (2, ""), (3, good), (5, "x")])
            if not empty and name in ("PII", "SentencePiece encoding and decoding"):
                assert out.count() == len(rows)

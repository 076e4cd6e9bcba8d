"""What is shuffled, and how often; shuffles that go once a table is kept."""

import time

import pytest
from pyspark.sql import functions as F

from docfoundry.operators import chunking, points, questions
from docfoundry.operators.lines import left_joined
from docfoundry.plans.registry import Tables
from docfoundry.plans.structure import both_kinds
from docfoundry.sources.files import kept

CHUNK = "doc_id long, place int, type string, path string, content string"
CHUNKS = [(1, 1, "Text", "# a", "x"), (1, 2, "Table", "# a --> b", "y"), (1, 2, "Table", "# a --> b", "y"), (2, 1, "Summary", "", "z"), (2, 2, None, "", "w"), (None, 1, "Text", "", "v"), (3, None, "Table", "", "u")]


@pytest.fixture
def chunks(spark, tmp_path):
    spark.createDataFrame(CHUNKS, CHUNK).write.parquet(f"{tmp_path}/chunks")
    return spark.read.parquet(f"{tmp_path}/chunks")


def exchanges(df, scan="content"):
    """How many exchanges are above each scan of a column, in the plan as it is before it runs."""
    above, found = [], []
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        depth = len(line) - len(line.lstrip(" :+-"))
        above = [x for x in above if x[0] < depth] + [(depth, "Exchange" in line)]
        if "FileScan" in line and scan in line:
            found.append(sum(x for _, x in above))
    return found


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_forms_of_prompts_read_chunks_once(spark, chunks):
    names = spark.createDataFrame([(1, "f"), (1, "g"), (None, "h")], "doc_id long, file_name string")
    briefs = spark.createDataFrame([(2, "s")], "doc_id long, summary string")
    found = questions.qa_prompts(chunks, questions.FORMS, names, briefs)
    each = [questions.qa_prompts(chunks, f, names, briefs).select(F.lit(f).alias("form"), "doc_id", "place", "prompt") for f in questions.FORMS]
    assert exchanges(found) == [1]
    assert rows(found) == rows(each[0].union(each[1]).union(each[2])) and found.count() == 18


def test_questions_meet_chunks_by_document(spark, chunks):
    q = [("q", "a", None, None)]
    qas = spark.createDataFrame([(1, 2, q), (1, 2, None), (1, 2, q), (2, 9, q), (None, 1, q), (3, None, q), (2, 1, [])], f"doc_id long, place int, qas {questions.QA}")
    plain = chunks.join(qas, ["doc_id", "place"], "left")
    assert rows(left_joined(chunks, qas, ["doc_id", "place"])) == rows(plain) and plain.count() == 11
    table = questions.qa_table(chunks.filter("place is not null"), qas)
    assert exchanges(table) == [1]
    got = {r["doc_id"]: sorted((c["place"], len(c["qas"])) for c in r["chunks"]) for r in table.collect()}
    assert got == {1: [(1, 0), *[(2, 0)] * 2, *[(2, 1)] * 4], 2: [(1, 0), (2, 0)], None: [(1, 0)]}


def test_texts_of_points_are_shuffled_once(spark, tmp_path):
    made = [("d1", 1, 1, "Text", True, "x"), ("d1", 1, 2, "Text", True, "y"), ("d1", 1, 2, "Text", True, "y"), ("d2", 1, 1, "Table", False, "t"), ("d3", 1, 1, "Text", True, "z"), (None, 1, 1, "Text", True, "n"), ("d3", 1, None, "Text", True, "m")]
    spark.createDataFrame(made, "document_id string, dataset_id long, chunk_index int, type string, needs_summary boolean, content string").write.parquet(f"{tmp_path}/chunks")
    chunks = spark.read.parquet(f"{tmp_path}/chunks")
    cached = spark.createDataFrame([("d1", 2, "c"), ("d1", 2, "d"), (None, 1, "no"), ("d9", 1, "no")], "document_id string, chunk_index int, summary string")
    answers = spark.createDataFrame([("d1", 2, "e"), ("d3", 1, " made<|return|>"), ("d3", None, "no")], "document_id string, chunk_index int, text string")
    json = spark.createDataFrame([("d1", '{"k":"v"}')], "document_id string, payload string")
    metadata = spark.createDataFrame([], "document_id string, template string, json string")
    found = points.new_points(chunks, cached, answers, metadata, json, {"t": '{"type":"object","properties":{"k":{"type":"string"}}}'}, lambda c: F.array(F.length(c).cast("float")))
    assert exchanges(found) == [1]
    got = [(r["document_id"], r["content"], r["content_full"], r["payload"]) for r in found.collect()]
    v = {"k": "v"}
    want = [("d1", "x", None, v), *[("d1", "c", "y", v), ("d1", "d", "y", v)] * 2, ("d2", "t", None, {}), ("d3", "made", "z", {}), (None, "n", None, {}), ("d3", "m", None, {})]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_text_chunks_stay_where_they_are_cut(spark):
    merged = chunking.merge_and_reindex(*both_kinds(Tables(spark, "/root/testdata/sf0.001")), 64)
    above = merged._jdf.queryExecution().executedPlan().toString().split("Union")[0]
    assert "Window" in above and "Exchange" not in above


def test_shuffles_go_once_a_table_is_kept(spark):
    files = lambda: {x for x in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString(",").split(",") if "/shuffle_" in x}
    before = files()
    table = kept(spark.range(1000).repartition(5, "id").groupBy(F.col("id") % 7).count(), "some", clean=True)
    for _ in range(20):
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left and table.count() == 7

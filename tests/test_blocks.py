"""Texts cut in Arrow batches against classified lines, and what their plans leave out."""

import random

import pytest
from pyspark.sql import functions as F

from docfoundry.operators import blocks, chunking, lines, tables

PARTS = ["# A", "## B c", "###### x", "####### no", "#", "##\r", "  # q", "Title", "====", "---", " - - -", "***", "- a", "1. b", "> q", "    ind", "\tind", "| a | b |", "|---|:-:|", "| 1 |", "a | b", "|---|\r"]
PARTS += ["", "", "  ", "\t", "```", "~~~", "```x", "````", "<div>", "<TABLE><tr>", "<table><tr><th>x</th></tr></table>", "<3", "ü | ß", "日本 # x", " ", "=== ", "\x0b", "---\x85", "-\r"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(7)
    texts = ["", "\n", "\n\n", "a", "# a\n", "```x\n", *("\n".join(rng.choice(PARTS) for _ in range(rng.randint(1, 25))) + rng.choice(["", "\n"]) for _ in range(2500))]
    return spark.createDataFrame([*enumerate(texts), (10**6, None)], "doc_id long, text string").repartition(4).cache()


@pytest.fixture(scope="module")
def classified(docs):
    return lines.classify_lines(docs).cache()


def same(a, b):
    x, y = (sorted(map(repr, df.collect())) for df in (a, b.select(a.columns)))
    assert x == y and x


def test_blocks_are_runs_of_classified_lines(docs, classified):
    runs = tables._blocks(classified).select("doc_id", "start", "end", F.size("lines").alias("n_lines"), "kind", F.array_join("lines", "\n").alias("text"))
    same(runs, blocks.block_lists(docs).select("doc_id", F.inline("b")))


def test_sections_are_those_of_classified_lines(docs, classified):
    own = ["doc_id", "n", "level", "head", "start", "size", "trivial", "blank", "content"]
    same(chunking._sections(classified).select(own), blocks.section_lists(docs).select("doc_id", F.inline("s")))


@pytest.mark.parametrize("policy", ["split", "merge"])
def test_table_chunks_of_texts_are_those_of_their_lines(docs, classified, policy):
    answers = docs.select("doc_id", F.lit(2).alias("table_index"), F.when(F.col("doc_id") % 2 == 0, "yes").otherwise("no").alias("answer"))
    same(tables.table_chunks(classified, policy, answers), tables.document_table_chunks(docs, policy, answers))


def test_text_chunks_of_texts_are_those_of_their_lines(docs, classified):
    same(chunking.chunks_of_lines(classified, 12), chunking.text_chunks(docs, 12))


def test_a_text_is_cut_once_and_its_lines_are_never_sorted(docs):
    """Lines used to be sorted, in memory that grew with all lines of a task, and windowed a dozen times."""
    for made in (tables.document_table_chunks(docs, "merge"), blocks.section_lists(docs)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1
        assert not any(x in plan for x in ("Sort", "Window", "Aggregate"))


def test_trivial_contents_with_and_without_tags(spark):
    """A tag at the end, trivial itself, leads to the way for contents with tags."""
    rng = random.Random(3)
    parts = ["# A", "", "---", " ", "#", "#\r", "* * *", "## b c", "\t", "===", "- - -\x85", "a", "    # x"]
    texts = ["\n".join(rng.choice(parts) for _ in range(rng.randint(1, 5))) for _ in range(3000)]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    got = d.select("t", chunking.is_trivial(F.col("t")).alias("a"), chunking.is_trivial(F.concat("t", F.lit("\n\n<b>"))).alias("b")).collect()
    assert {r.a for r in got} == {True, False}
    assert not [r for r in got if r.a != r.b]

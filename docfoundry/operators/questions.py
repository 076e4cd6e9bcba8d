"""Prompts for summaries, metadata and questions, and the tables that responses become."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfoundry.functions.text import clean_response, first_pages, repair_json

from .lines import left_joined

QA = "array<struct<question:string,answer:string,category:string,qa_type:string>>"


def fill(template: str, *values: Column) -> Column:
    """A template with {0}, {1} .. replaced, in any order and as often as they come; what values hold isn't looked at again."""
    parts = re.split(r"\{(\d+)\}", template)
    return F.concat(*(F.coalesce(values[int(x)], F.lit("")) if i % 2 else F.lit(x) for i, x in enumerate(parts)))


def summary_prompts(sections: DataFrame, names: DataFrame, template: str = "Summarise {0}:\n{1}") -> DataFrame:
    """(doc_id, section, prompt), one for each section; its name is file[section], or the file's alone for a single one."""
    n = sections.groupBy("doc_id").agg(F.count("*").alias("n"))
    name = F.coalesce("file_name", F.lit("SummaryDocument"))
    label = F.when(F.col("n") > 1, F.concat(name, F.lit("["), F.when(F.col("title") != "", F.col("title")).otherwise(F.concat(F.lit("Section "), F.col("section").cast("string"))), F.lit("]"))).otherwise(name)
    joined = sections.join(n, "doc_id").join(names.select("doc_id", "file_name"), "doc_id", "left")
    return joined.select("doc_id", "section", fill(template, label, F.col("content")).alias("prompt"))


def summary_merge_lists(sections: DataFrame) -> DataFrame:
    """(doc_id, outline, bodies, n): titles as a list and sections one after the other, in order; `Section i` where there is no title."""
    title = F.when(F.col("title") != "", F.col("title")).otherwise(F.concat(F.lit("Section "), F.col("section").cast("string")))
    parts = sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("section", title.alias("title"), "content"))).alias("p"))
    return parts.select(
        "doc_id",
        F.array_join(F.transform("p", lambda x: F.concat(F.lit("- "), x["title"])), "\n").alias("outline"),
        F.array_join(F.transform("p", lambda x: F.concat(F.lit("## "), x["title"], F.lit("\n"), x["content"])), "\n\n").alias("bodies"),
        F.size("p").alias("n"),
    )


def merge_prompts(summaries: DataFrame, template: str = "Merge these summaries.\n{0}\n\n{1}") -> DataFrame:
    """(doc_id, prompt) of documents with several sections."""
    return summary_merge_lists(summaries).filter("n > 1").select("doc_id", fill(template, F.col("outline"), F.col("bodies")).alias("prompt"))


#: What each form of question prompt asks of: chunks of these kinds; {0} .. are file name, summary, title, path and content.
FORMS = {
    "text": (("Text", "Summary"), "Ask about this part of {0}.\n{1}\n{4}"),
    "table": (("Table",), "Ask about the table {2} ({3}) of {0}.\n{1}\n{4}"),
    "combined": (("Text", "Summary", "Table"), "Ask about {2} ({3}) of {0}.\n{1}\n{4}"),
}


def qa_prompts(chunks: DataFrame, form: str | Iterable[str] = "table", names: DataFrame | None = None, summaries: DataFrame | None = None, template: str | None = None) -> DataFrame:
    """(doc_id, place, prompt) of the chunks that a form asks of; file names (doc_id, file_name) and summaries (doc_id, summary) are empty
    where there are none. Of several forms, (form, doc_id, place, prompt) of each: chunks are read, and meet names and summaries, once."""
    forms = {f: FORMS[f] for f in ([form] if isinstance(form, str) else form)}
    rows = chunks.filter(F.col("type").isin(*{k for kinds, _ in forms.values() for k in kinds}))
    for df, column in ((names, "file_name"), (summaries, "summary")):
        rows = rows.withColumn(column, F.lit("")) if df is None else rows.drop(column).join(df.select("doc_id", column), "doc_id", "left")
    title = F.col("title") if "title" in chunks.columns else F.substring_index("path", " --> ", -1)
    values = F.col("file_name"), F.col("summary"), title, F.col("path"), F.col("content")
    if isinstance(form, str):
        return rows.select("doc_id", "place", fill(template or forms[form][1], *values).alias("prompt"))
    asked = F.array(*(F.when(F.col("type").isin(*kinds), F.struct(F.lit(f).alias("form"), fill(template or usual, *values).alias("prompt"))) for f, (kinds, usual) in forms.items()))
    # without outer the prompts would be made a second time, to leave out empty lists
    return rows.select("doc_id", "place", F.inline_outer(asked)).filter("form is not null").select("form", "doc_id", "place", "prompt")


def metadata_prompts(documents: DataFrame, schemas: DataFrame, template: str = "Schema:\n{0}\n\nText:\n{1}", pages: int = 10) -> DataFrame:
    """(doc_id, prompt) of documents (doc_id, template_id, content) with a template and content: their first pages and the schema."""
    return documents.filter("content is not null and content <> ''").join(schemas.select("template_id", "json_schema"), "template_id").select("doc_id", fill(template, F.col("json_schema"), first_pages(F.col("content"), pages)).alias("prompt"))


def parse_qa_responses(responses: DataFrame) -> DataFrame:
    """(doc_id, place, qas) of responses (doc_id, place, text): the list a response holds, empty where it doesn't parse."""
    parsed = F.from_json(repair_json(clean_response(F.col("text"), thinking=True)), QA)
    return responses.select("doc_id", "place", F.coalesce(F.filter(parsed, lambda q: q["question"].isNotNull()), F.array().cast(QA)).alias("qas"))


def qa_table(chunks: DataFrame, qas: DataFrame) -> DataFrame:
    """(doc_id, chunks): a document's chunks in order, each with its questions, empty without."""
    joined = left_joined(chunks.select("doc_id", "place", "type", "path", "content"), qas.select("doc_id", "place", "qas"), ["doc_id", "place"]).withColumn("qas", F.coalesce("qas", F.array().cast(QA)))
    each = F.struct("place", F.struct("type", "path", "content").alias("chunk"), "qas")
    return joined.groupBy("doc_id").agg(F.array_sort(F.collect_list(each), lambda a, b: (a["place"] - b["place"]).cast("int")).alias("chunks"))


def exploded_qas(table: DataFrame) -> DataFrame:
    """(doc_id, place, question, answer, category, qa_type), one for each question."""
    return table.select("doc_id", F.explode("chunks").alias("c")).select("doc_id", "c.place", F.inline("c.qas"))


def chunks_to_json(chunks: DataFrame, columns: tuple[str, ...] = ("chunk_index", "type", "tokens", "path", "content")) -> DataFrame:
    """(doc_id, json): a document's chunks in order as one JSON list."""
    return chunks.groupBy("doc_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("place", F.struct(*columns).alias("c")))), lambda x: x["c"])).alias("json"))


def chunks_from_json(packed: DataFrame) -> DataFrame:
    """chunks_to_json() undone; what isn't a list of chunks has none."""
    kind = "array<struct<chunk_index:int,type:string,tokens:bigint,path:string,content:string>>"
    return packed.select("doc_id", F.posexplode(F.from_json("json", kind)).alias("place", "c")).select("doc_id", (F.col("place") + 1).alias("place"), "c.*")


def progress_report(events: DataFrame) -> DataFrame:
    """(task_id, status, done, total, seconds): the latest status and `done/total` of a task's messages, and its time."""
    done, total = (F.regexp_extract("message", r"(\d+)\s*/\s*(\d+)", i).try_cast("int") for i in (1, 2))
    order = F.struct("ts", "event_id")
    return events.groupBy("task_id").agg(
        F.max_by("status", order).alias("status"),
        F.max_by(done, F.when(done.isNotNull(), order)).alias("done"),
        F.max_by(total, F.when(total.isNotNull(), order)).alias("total"),
        F.round(F.sum(F.coalesce("processing_time", F.lit(0.0))), 4).alias("seconds"),
    )

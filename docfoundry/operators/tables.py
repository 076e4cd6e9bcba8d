"""Tables that page breaks have cut: what they look like, how alike two are, which continue one another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import block_lists
from .lines import count_tokens

#: Similarities at or over and at or under which no one is asked.
SAME, DIFFERENT = 0.70, 0.25


def bigrams(s: Column) -> Column:
    return F.when(F.length(s) > 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: s.substr(i, F.lit(2))))).otherwise(F.array().cast("array<string>"))


def prepared(cells: Column) -> Column:
    """Cells (x, g) ready to be compared: trimmed, in lower case, with their bigrams, which are made once for each cell."""
    return F.transform(F.transform(cells, lambda c: F.lower(F.trim(c))), lambda x: F.struct(x.alias("x"), bigrams(x).alias("g")))


def _dice(p: Column, q: Column) -> Column:
    return F.when(p["x"] == q["x"], 1.0).when((F.size(p["g"]) == 0) | (F.size(q["g"]) == 0), 0.0).otherwise(2.0 * F.size(F.array_intersect(p["g"], q["g"])) / (F.size(p["g"]) + F.size(q["g"])))


def _alike(p: Column, q: Column) -> Column:
    # fixed values: what equal, contained and similar cells count
    blank = F.coalesce(p["x"], F.lit("")) == ""
    return F.when(blank | (F.coalesce(q["x"], F.lit("")) == ""), 0.0).when(p["x"] == q["x"], 1.0).when(p["x"].contains(q["x"]) | q["x"].contains(p["x"]), 0.8).when(_dice(p, q) >= 0.6, 0.6).otherwise(0.0)


def _one(pairs: Column) -> Column:
    return F.get(pairs, F.lit(0))


def dice(a: Column, b: Column) -> Column:
    """Twice the shared bigrams over all of both; 1 for equal texts, 0 without bigrams."""
    with_grams = lambda s: F.struct(s.alias("x"), bigrams(s).alias("g"))
    return _dice(with_grams(a), with_grams(b))


def cell_similarity(a: Column, b: Column) -> Column:
    return _alike(_one(prepared(F.array(a))), _one(prepared(F.array(b))))


def prepared_similarity(a: Column, b: Column) -> Column:
    """header_similarity() of prepared() cells."""
    few, many = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    cells = F.zip_with(F.slice(a, 1, few), F.slice(b, 1, few), _alike)
    total = F.aggregate(cells, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.coalesce(few, F.lit(0)) <= 0, 0.0).otherwise(total / few * (few.cast("double") / many))


def header_similarity(a: Column, b: Column) -> Column:
    """Mean similarity of cells at the same place, less what differs in their number."""
    return prepared_similarity(prepared(a), prepared(b))


def column_similarity(a: Column, b: Column) -> Column:
    return F.when(a == b, 1.0).when(F.abs(a - b) == 1, 0.4).otherwise(0.0)


def table_similarity(t1: Column, t2: Column) -> Column:
    """For structs (column_count, header_cells, has_header, ..); instead of header_cells they may hold `cells`, prepared()."""
    return _table_similarity(t1, t2, header_similarity(t1["header_cells"], t2["header_cells"]))


def _table_similarity(t1: Column, t2: Column, headers: Column) -> Column:
    columns = column_similarity(t1["column_count"], t2["column_count"])
    # fixed values: what headers and columns count, and scores where a header is missing
    return F.when(t1["has_header"] & t2["has_header"], 0.8 * headers + 0.2 * columns).when(t1["has_header"], 0.7 + 0.2 * columns).when(t2["has_header"], 0.1 + 0.2 * columns).otherwise(0.5 + 0.4 * columns)


def continuation_decision(least: Column, most: Column) -> Column:
    """Whether a table goes on; null where the scores don't tell."""
    return F.when(least >= SAME, True).when(most <= DIFFERENT, False)


_ITEM = "struct<table_index:int,column_count:int,cells:array<struct<x:string,g:array<string>>>,has_header:boolean,answer:string>"
_STEP = "struct<table_index:int,segment:int,min_score:double,max_score:double,method:string,merged:boolean,refs:array<int>,scores:array<double>>"


def _folded(items: Column, policy: str, brief: bool = False) -> Column:
    """An array of _STEP for a column of _ITEM in order; brief: only the places, from 1, of items that open a segment.

    Of the items compared with, the fold holds places alone: items themselves would be copied at every step.
    """
    out = "array<int>" if brief else f"array<{_STEP}>"
    start = F.struct(F.array().cast("array<int>").alias("refs"), F.array().cast(out).alias("out"), F.lit(0).alias("segment"), F.lit(0).alias("at"))

    def fold(acc: Column, t: Column) -> Column:
        against = lambda r: _table_similarity(r, t, prepared_similarity(r["cells"], t["cells"]))
        seen = F.struct(acc.alias("acc"), t.alias("t"), F.transform(acc["refs"], lambda r: against(F.get(items, r - 1))).alias("scores"))
        return _one(F.transform(F.array(seen), decided))  # scores are made once, and used several times

    def decided(s: Column) -> Column:
        acc, t, scores = s["acc"], s["t"], s["scores"]
        sure = F.when(F.size(scores) > 0, continuation_decision(F.array_min(scores), F.array_max(scores)))
        asked = F.coalesce(F.lower(F.trim(t["answer"])).startswith("y"), F.lit(policy == "merge"))
        merged = (acc["segment"] > 0) & F.coalesce(sure, asked)
        return _one(F.transform(F.array(F.struct(s.alias("s"), sure.alias("sure"), merged.alias("merged"))), step))

    def step(d: Column) -> Column:
        acc, t, scores, merged = d["s"]["acc"], d["s"]["t"], d["s"]["scores"], d["merged"]
        at = acc["at"] + 1
        segment = F.when(merged, acc["segment"]).otherwise(acc["segment"] + 1)
        own = F.when(t["has_header"], F.array(at)).otherwise(F.array().cast("array<int>"))
        refs = F.when(merged, F.concat(acc["refs"], own)).otherwise(own)
        if brief:
            done = F.when(merged, acc["out"]).otherwise(F.array_append(acc["out"], at))
        else:
            first = acc["segment"] == 0
            shown = F.struct(
                t["table_index"].alias("table_index"),
                segment.alias("segment"),
                F.round(F.when(~first, F.array_min(scores)), 4).alias("min_score"),
                F.round(F.when(~first, F.array_max(scores)), 4).alias("max_score"),
                F.when(first, "first").when(d["sure"].isNotNull(), "heuristic").otherwise("grey").alias("method"),
                merged.alias("merged"),
                F.transform(acc["refs"], lambda r: F.get(items, r - 1)["table_index"]).alias("refs"),
                F.transform(scores, lambda x: F.round(x, 4)).alias("scores"),
            )
            done = F.array_append(acc["out"], shown.cast(_STEP))
        return F.struct(refs.alias("refs"), done.cast(out).alias("out"), segment.cast("int").alias("segment"), at.alias("at"))

    return F.aggregate(items, start, fold, lambda acc: acc["out"])


def table_decisions(tables: DataFrame, policy: str = "split", answers: DataFrame | None = None) -> DataFrame:
    """(doc_id, table_index, segment, min_score, max_score, method, merged, refs, scores): a fold over each document's tables in order.

    A candidate is compared with the tables with headers of the open segment, refs, which give the scores. Where these don't tell, or
    there is none, the answers (doc_id, table_index, answer) decide - y.. merges - and without an answer the policy does.
    """
    rows = tables.select("doc_id", "table_index", "column_count", prepared(F.col("header_cells")).alias("cells"), "has_header")
    if answers is not None:
        rows = rows.join(answers.select("doc_id", "table_index", "answer"), ["doc_id", "table_index"], "left")
    else:
        rows = rows.withColumn("answer", F.lit(None).cast("string"))
    info = F.struct("table_index", "column_count", "cells", "has_header", "answer")
    docs = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(info)).cast(f"array<{_ITEM}>").alias("tables"))
    return docs.select("doc_id", F.inline(_folded(F.col("tables"), policy)))


def table_segments(tables: DataFrame, policy: str = "split", answers: DataFrame | None = None) -> DataFrame:
    """table_decisions() without what was compared."""
    return table_decisions(tables, policy, answers).drop("refs", "scores")


def decision_totals(decisions: DataFrame) -> DataFrame:
    """(method, merged, n) over table_decisions()."""
    return decisions.groupBy("method", "merged").agg(F.count("*").alias("n"))


def _cells(row: Column) -> Column:
    inner = F.regexp_replace(F.trim(row), r"^\||\|$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|"), lambda c: F.trim(c))


def pipe_table_info(lines: Column) -> Column:
    """A struct (column_count, header_cells, has_header, row_count) of an array of a pipe table's lines: a header, dashes, rows."""
    return _pipe_info(lines[0], F.size(lines))


def _pipe_info(first: Column, n_lines: Column) -> Column:
    # cells are found once, however often the struct names them
    return _one(F.transform(F.array(_cells(first)), lambda head: F.struct(F.size(head).alias("column_count"), head.alias("header_cells"), F.lit(True).alias("has_header"), F.greatest(n_lines - 2, F.lit(0)).alias("row_count"))))


def strip_nested_tables(html: Column) -> Column:
    """Only what stands at depth 1, the outer tags bare: a running depth over the pieces between tags.

    A tag is <table before a blank, > or /, up to its >, or </table>; a closing tag always lowers the depth, below 0 too.
    """
    pieces = F.filter(F.split(F.regexp_replace(html, r"(?i)(<table(?=[\s>/]|$)[^>]*>?|</table>)", "\u0001$1\u0001"), "\u0001"), lambda p: p != "")
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        opens, closes = p.rlike(r"(?i)^<table(?=[\s>/]|$)"), F.lower(p) == "</table>"
        depth = acc["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        text = F.when(opens & (depth == 1), "<table>").when(closes & (depth == 0), "</table>").when(~opens & ~closes & (depth == 1), p).otherwise("")
        return F.struct(depth.alias("depth"), F.array_append(acc["out"], text).alias("out"))

    return F.when(html.isNotNull(), F.array_join(F.aggregate(pieces, start, step, lambda acc: acc["out"]), ""))


def html_table_info(html: Column) -> Column:
    """The same struct of an HTML table: a header if there is any th; its cells are those of the first row that has one. Spans don't count."""
    # fixed values: the patterns of rows, cells and headers
    cells = lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<(?:td|th)[^>]*>(.*?)</(?:td|th)>"), F.lit(1)), lambda c: F.trim(c))

    def of_rows(x: Column) -> Column:
        has, rows = x["has"], x["rows"]
        head = F.get(F.filter(rows, lambda r: r.rlike(r"(?i)<th[^>]*>")), F.lit(0))
        return F.struct(
            F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(cells(r)))), F.lit(0)).alias("column_count"),
            F.when(has, cells(head)).alias("header_cells"),
            has.alias("has_header"),
            F.when(has, F.greatest(F.size(rows) - 1, F.lit(0))).otherwise(F.size(rows)).alias("row_count"),
        )

    def found(outer: Column) -> Column:
        rows = F.regexp_extract_all(outer, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
        return F.struct(outer.rlike(r"(?i)<th[\s>]").alias("has"), rows.alias("rows"))

    # nested tables are stripped once, and rows are found once, however often the struct names them
    return _one(F.transform(F.transform(F.array(strip_nested_tables(html)), found), of_rows))


def _blocks(lines: DataFrame) -> DataFrame:
    """(doc_id, run, kind, start, end, first_n, last_n, head, lines): runs of lines of one kind; head is the last line of headings and quotes."""
    by_doc = Window.partitionBy("doc_id").orderBy("n")
    fresh = F.col("kind") != F.coalesce(F.lag("kind").over(by_doc), F.lit(""))
    runs = lines.withColumn("_fresh", fresh.cast("int")).withColumn("run", F.sum("_fresh").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"])
    return runs.groupBy("doc_id", "run", "kind").agg(
        F.min("start").alias("start"),
        F.max(F.col("start") + F.length("line") - 1).alias("end"),
        F.min("n").alias("first_n"),
        F.max("n").alias("last_n"),
        F.max_by(F.trim(F.coalesce("head", "line")), "n").alias("head"),
        text.alias("lines"),
    )


def _with_info(blocks: DataFrame) -> DataFrame:
    """Blocks with info: the table that they hold, else null; text: their lines joined."""
    b = blocks.withColumn("text", F.array_join("lines", "\n"))
    return b.withColumn("info", _info(F.col("kind"), F.col("text"), F.size("lines"))).drop("lines")


def _info(kind: Column, text: Column, n_lines: Column) -> Column:
    pipe = _pipe_info(F.substring_index(text, "\n", 1), n_lines)
    return F.when(kind == "table", pipe).when((kind == "html") & F.ltrim(text).rlike("(?i)^<table"), html_table_info(text))


def tables_of(lines: DataFrame) -> DataFrame:
    """(doc_id, table_index, start, end, first_n, last_n, column_count, header_cells, has_header, row_count) of the pipe tables and HTML
    tables among classified lines. `end` is the place of the last character."""
    found = _with_info(_blocks(lines).filter("kind in ('table', 'html')")).filter("info is not null")
    return found.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("first_n")).alias("table_index"), "start", "end", "first_n", "last_n", "info.*")


def table_title(lines: DataFrame) -> DataFrame:
    """lines with title: the last heading or quote before each line, empty without."""
    earlier = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("title", F.coalesce(F.last(F.when(F.col("kind").isin("heading", "quote"), F.trim(F.coalesce("head", "line"))), ignorenulls=True).over(earlier), F.lit("")))


def table_chunks(lines: DataFrame, policy: str = "split", answers: DataFrame | None = None, counter: Callable[[Column], Column] = count_tokens) -> DataFrame:
    """(doc_id, table_index, title, path, tokens, content, start, end): one chunk for each segment of tables, from the first one's start to
    the last one's end, with what stands between.

    A document's blocks come together in one row, as its text did before: the fold over its tables and the texts of the segments
    need no join back to lines.
    """
    so_far = Window.partitionBy("doc_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    title = F.coalesce(F.last(F.when(F.col("kind").isin("heading", "quote"), F.col("head")), ignorenulls=True).over(so_far), F.lit(""))
    b = _with_info(_blocks(lines)).withColumn("title", title)
    docs = b.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("run", "start", "end", "title", "text"))).alias("b"), F.sort_array(F.collect_list(F.when(F.col("info").isNotNull(), F.struct("run", "info")))).alias("t"))
    return _segments(docs.filter("size(t) > 0"), policy, answers, counter)


def document_table_chunks(docs: DataFrame, policy: str = "split", answers: DataFrame | None = None, counter: Callable[[Column], Column] = count_tokens) -> DataFrame:
    """table_chunks() of texts (doc_id, text), without rows of lines."""
    found = block_lists(docs).filter(F.exists("b", lambda x: x["kind"].isin("table", "html")))
    info = F.transform("b", lambda x, i: F.struct((i + 1).alias("run"), _info(x["kind"], x["text"], x["n_lines"]).alias("info")))
    return _segments(found.withColumn("t", F.filter(info, lambda x: x["info"].isNotNull())), policy, answers, counter)


def _segments(docs: DataFrame, policy: str, answers: DataFrame | None, counter: Callable[[Column], Column]) -> DataFrame:
    """table_chunks() of documents (doc_id, b, t): their blocks, and which of them are tables."""
    if answers is None:
        docs = docs.withColumn("a", F.create_map().cast("map<int,string>"))
    else:
        each = answers.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("table_index").cast("int"), "answer"))).alias("a"))
        docs = docs.join(each, "doc_id", "left").withColumn("a", F.coalesce("a", F.create_map().cast("map<int,string>")))
    items = F.transform("t", lambda x, i: F.struct((i + 1).alias("table_index"), x["info"]["column_count"].alias("column_count"), prepared(x["info"]["header_cells"]).alias("cells"), x["info"]["has_header"].alias("has_header"), F.try_element_at("a", i + 1).alias("answer")))
    steps = docs.withColumn("items", items.cast(f"array<{_ITEM}>")).withColumn("opens", _folded(F.col("items"), policy, brief=True))
    # a segment lasts from a table that doesn't go on to the table before the next such
    at = lambda i: F.get("t", i - 1)["run"]
    spans = F.transform("opens", lambda o, i: F.struct((i + 1).alias("segment"), at(o).alias("first"), at(F.coalesce(F.get("opens", i + 1) - 1, F.size("t"))).alias("last")))
    found = steps.withColumn("spans", spans)
    runs = lambda s: F.slice("b", s["first"].cast("int"), (s["last"] - s["first"] + 1).cast("int"))
    made = F.transform("spans", lambda s: F.struct(
        s["segment"].alias("table_index"),
        F.get("b", s["first"].cast("int") - 1)["title"].alias("title"),
        F.lit("").alias("path"),
        F.array_join(F.transform(runs(s), lambda x: x["text"]), "\n").alias("content"),
        F.get("b", s["first"].cast("int") - 1)["start"].alias("start"),
        F.get("b", s["last"].cast("int") - 1)["end"].alias("end"),
    ))
    # without outer all of this would be made a second time, to leave out documents without a segment
    return found.select("doc_id", F.inline_outer(made)).filter(F.col("table_index").isNotNull()).select("doc_id", "table_index", "title", "path", counter(F.col("content")).alias("tokens"), "content", "start", "end")


def remove_tables(lines: DataFrame) -> DataFrame:
    """(doc_id, text) of texts without their pipe tables and the HTML blocks that begin with <table, in lower case; a table leaves one
    empty line."""
    b = _blocks(lines).withColumn("text", F.array_join("lines", "\n"))
    drop = (F.col("kind") == "table") | ((F.col("kind") == "html") & F.ltrim("text").startswith("<table"))
    parts = F.sort_array(F.collect_list(F.struct("run", F.when(drop, "").otherwise(F.col("text")).alias("t"))))
    return b.groupBy("doc_id").agg(F.regexp_replace(F.array_join(F.transform(parts, lambda x: x["t"]), "\n"), r"^\s+|\s+$", "").alias("text"))

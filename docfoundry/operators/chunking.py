"""Chunks of Markdown texts along their headings.

Texts are cut into sections, each a heading with what follows it, a list of them a document; levels are cut in these lists. Chunks meet
their document in one exchange by doc_id; all later windows and groups are by document or finer and need no other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import DEPTH, section_lists
from .lines import classify_lines, count_tokens, dealt

MAX_TOKENS, SUMMARY_TOKENS = 8192, 100_000
_TRIVIAL = ("heading", "html", "rule", "blank")
_LEVELS = range(1, DEPTH + 1)
#: the beginning of a line that isn't blank, a heading or a rule
_TELLING = r"(?dm)^(?! *$)(?!(?<=\n)[ \t]*$)(?! {0,3}#{1,6}(?:[ \t]|[\r\u0085\u2028\u2029]?$))(?! {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}[\r\u0085\u2028\u2029]?$)"


def _in_order(n: Column, text: Column, by: str = "") -> Column:
    """The texts of a group in the order of n, joined."""
    ordered = F.sort_array(F.collect_list(F.struct(n.alias("n"), text.alias("t"))))
    return F.array_join(F.transform(ordered, lambda x: x["t"]), by)


def _sections(lines: DataFrame) -> DataFrame:
    """(doc_id, n, level, head, start, size, tokens, trivial, blank, content): runs of lines from one heading of level 1 to 5 to the next;
    n is the run's first line, level 0 if it has no heading."""
    cuts = F.col("level").between(1, DEPTH)
    so_far = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    runs = lines.withColumn("_first", F.coalesce(F.max(F.when(cuts, F.col("n"))).over(so_far), F.lit(1)))
    whole = F.when(F.col("is_last"), F.col("line")).otherwise(F.concat("line", F.lit("\n")))
    return runs.groupBy("doc_id", F.col("_first").alias("n")).agg(
        F.coalesce(F.max(F.when(cuts, F.col("level"))), F.lit(0)).alias("level"),
        F.max(F.when(cuts, F.col("head"))).alias("head"),
        F.min("start").alias("start"),
        F.sum(F.length(whole)).alias("size"),
        F.sum("tokens").alias("tokens"),
        F.bool_and(F.col("kind").isin(*_TRIVIAL)).alias("trivial"),
        F.bool_and(F.col("kind") == "blank").alias("blank"),
        _in_order(F.col("n"), whole).alias("content"),
    )


def adds_up(counter: Callable[[Column], Column]) -> bool:
    """Whether the tokens of lines add up to those of their text: so by default for count_tokens alone; a counter with an attribute
    `adds_up` says for itself."""
    return getattr(counter, "adds_up", counter is count_tokens)


def _listed(sections: DataFrame) -> DataFrame:
    """(doc_id, s): the _sections() of each document in order."""
    return sections.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*(c for c in sections.columns if c != "doc_id")))).alias("s"))


def _section_lists(docs: DataFrame, counter: Callable[[Column], Column]) -> DataFrame:
    """_listed() sections of texts, cut without rows of lines, and counted where that is of use."""
    own = ("n", "level", "head", "start", "size", "trivial", "blank", "content")
    tokens = counter if adds_up(counter) else count_tokens
    return section_lists(docs).withColumn("s", F.transform("s", lambda x: F.struct(*(x[c].alias(c) for c in own), tokens(x["content"]).alias("tokens"))))


def _fragments(sections: DataFrame, is_open, depth: int, counter: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, n, begins, head, p, q, keep, start, size, tokens, trivial, blank, content, path): what is left uncut of _listed() sections.
    begins: the level of the part whose heading it starts with, 0 if there is none; p: the array p0 .. p5, the part of each level that it
    lies in, named by its first line, 0 for the whole text; q: whether a heading of that level began the part; keep: whether no cut level
    leaves the fragment before its first heading.

    A row is a part with its sections in order, first the whole text; level by level those that are open are cut where sections of the
    level begin. Tokens are summed, or, as sub-word counters need, what a cut has changed is counted again on its own text.
    """
    text = F.array_join(F.transform("s", lambda x: x["content"]), "")
    if adds_up(counter):
        counted = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["tokens"])
    else:
        counted = F.coalesce(counter(text), F.lit(0)).cast("long")
    none = F.array().cast("array<string>")
    rows = sections.withColumns({"tokens": counted, "p": F.array(F.lit(0)), "q": F.array().cast("array<boolean>"), "heads": none, "begins": F.lit(0), "keep": F.lit(True)})
    for k in _LEVELS:
        if k > depth:
            rows = rows.withColumns({"p": F.concat("p", F.array(F.element_at("p", -1))), "q": F.concat("q", F.array(F.lit(False)))})
            continue
        last = F.size("s")
        begin = F.when(is_open(F.col("tokens")), F.filter(F.sequence(F.lit(0), last - 1), lambda i: F.get("s", i)["level"] == F.lit(k))).otherwise(F.array().cast("array<int>"))
        # what stands before the first heading of the level is a piece too
        begin = F.when((F.size(begin) == 0) | (F.get(begin, F.lit(0)) == 0), begin).otherwise(F.concat(F.array(F.lit(0)), begin))
        rows = rows.withColumn("_at", begin).withColumn("_cut", F.size("_at") > 0)
        piece = F.transform("_at", lambda b, i: F.struct(F.slice("s", b + 1, F.coalesce(F.get("_at", i + 1), F.size("s")) - b).alias("s"), (F.get("s", b)["level"] == k).alias("headed")))
        whole = F.array(F.struct(F.col("s"), F.lit(False).alias("headed")))
        # no list is empty; without outer they would be made a second time, to leave out empty ones
        rows = rows.withColumn("_piece", F.explode_outer(F.when(F.col("_cut"), piece).otherwise(whole)))
        headed, first = F.col("_piece.headed"), F.get("_piece.s", F.lit(0))
        rows = rows.select(
            "doc_id",
            F.col("_piece.s").alias("s"),
            "_cut",
            "tokens",
            F.concat("p", F.array(F.when(headed, first["n"]).otherwise(F.element_at("p", -1)))).alias("p"),
            F.concat("q", F.array(headed)).alias("q"),
            F.when(headed, F.concat("heads", F.array(first["head"]))).otherwise(F.col("heads")).alias("heads"),
            F.when(headed, k).otherwise(F.when(F.col("_cut"), 0).otherwise(F.col("begins"))).alias("begins"),
            (F.col("keep") & (headed | ~F.col("_cut"))).alias("keep"),
        )
        again = counted if adds_up(counter) else F.coalesce(counter(F.when(F.col("_cut"), text)), F.lit(0)).cast("long")
        rows = rows.withColumn("tokens", F.when(F.col("_cut"), again).otherwise(F.col("tokens"))).drop("_cut")
    first = F.get("s", F.lit(0))
    # a part's preamble starts with its heading, so it begins at that level still
    began = F.coalesce(*(F.when((first["level"] == k) & F.col("q")[k - 1], k) for k in _LEVELS), F.lit(0))
    return rows.select(
        "doc_id",
        first["n"].alias("n"),
        began.alias("begins"),
        first["head"].alias("head"),
        "p",
        "q",
        "keep",
        first["start"].alias("start"),
        F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["size"]).alias("size"),
        "tokens",
        F.forall("s", lambda x: x["trivial"]).alias("trivial"),
        F.forall("s", lambda x: x["blank"]).alias("blank"),
        text.alias("content"),
        F.array_join("heads", " --> ").alias("path"),
    )


def _with_waiting(fragments: DataFrame) -> DataFrame:
    """Fragments that are chunks with `waiting`: the headings (level, ahead, at, head, start) of parts without a chunk that they take.

    Within its parent a part without chunks hands its heading to the first chunk of the next part that has one; those at the end hand
    theirs to the parent's last chunk. What comes from higher levels stands further in front.
    """
    placed = fragments.withColumn("_c", F.when(F.col("is_chunk"), F.struct("n", "p")))
    by_doc = "ignore nulls over (partition by doc_id order by n)"
    placed = placed.withColumns({"_next": F.expr(f"lead(_c) {by_doc}"), "_last": F.expr(f"lag(_c) {by_doc}")})
    k = F.col("begins")
    same = lambda c, level: F.coalesce(F.get(F.col(f"{c}.p"), level) == F.get("p", level), F.lit(False))
    empty = (k > 0) & ~F.col("is_chunk") & ~same("_next", k)
    to = F.when(same("_next", k - 1), F.col("_next.n")).when(same("_last", k - 1), F.col("_last.n"))
    heading = F.struct(k.alias("level"), same("_next", k - 1).cast("int").alias("ahead"), F.col("n").alias("at"), "head", "start")
    body = F.struct("start", "size", "tokens", "path", "content")
    # a fragment is a chunk, or its heading waits for one, or it is left out
    moved = placed.withColumn("to", F.when(F.col("is_chunk"), F.col("n")).when(empty, to)).filter(F.col("to").isNotNull())
    moved = moved.select("doc_id", "to", F.when(F.col("is_chunk"), body).alias("own"), F.when(~F.col("is_chunk"), heading).alias("w"))
    taken = moved.groupBy("doc_id", F.col("to").alias("n")).agg(F.first("own", ignorenulls=True).alias("own"), F.sort_array(F.collect_list("w")).alias("waiting"))
    return taken.select("doc_id", "n", "own.*", "waiting")


def text_chunks(docs: DataFrame, max_tokens: int = MAX_TOKENS, depth: int = DEPTH, counter: Callable[[Column], Column] = count_tokens) -> DataFrame:
    """(doc_id, chunk_index, type, needs_summary, tokens, path, content, start, end) of texts cut where headings are, level by level,
    as long as a part has max_tokens or more. Texts without a line other than headings, HTML and rules have no chunk.

    counter: tokens of a text. Unless it adds_up(), each part is counted on its own text, as is a chunk that headings were put before.
    """
    return _chunks(_section_lists(docs, counter), max_tokens, depth, counter)


def chunks_of_lines(lines: DataFrame, max_tokens: int = MAX_TOKENS, depth: int = DEPTH, counter: Callable[[Column], Column] = count_tokens) -> DataFrame:
    """text_chunks() of lines that are classified already, with the same counter of tokens if that adds_up()."""
    return _chunks(_listed(_sections(lines)), max_tokens, depth, counter)


def _chunks(sections: DataFrame, max_tokens: int, depth: int, counter: Callable[[Column], Column]) -> DataFrame:
    over = F.col("tokens") >= max_tokens
    pieces = dealt(_fragments(sections, lambda tokens: tokens >= max_tokens, depth, counter).drop("q", "keep")).withColumn("is_chunk", ~F.col("blank") & (over | ~F.col("trivial")))
    taken = _with_waiting(pieces)
    some = F.size("waiting") > 0
    prefix = F.when(some, F.array_join(F.transform("waiting", lambda x: x["head"]), "\n"))
    ahead = F.array_min(F.transform(F.filter("waiting", lambda x: x["ahead"] == 1), lambda x: x["start"]))
    behind = F.array_max(F.transform(F.filter("waiting", lambda x: x["ahead"] == 0), lambda x: x["start"] + F.length(x["head"])))
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("n"))
    content = F.when(some, F.concat(prefix, F.lit("\n"), "content")).otherwise(F.col("content"))
    if adds_up(counter):
        total = F.col("tokens") + F.coalesce(counter(prefix), F.lit(0))
    else:
        total = F.when(some, F.coalesce(counter(F.when(some, content)), F.lit(0)).cast("long")).otherwise(F.col("tokens"))
    return taken.select(
        "doc_id",
        index.alias("chunk_index"),
        F.when(over, "Summary").otherwise("Text").alias("type"),
        over.alias("needs_summary"),
        total.alias("tokens"),
        "path",
        content.alias("content"),
        F.coalesce(ahead, "start").alias("start"),
        F.coalesce(behind, F.col("start") + F.col("size")).alias("end"),
    )


def summary_sections(docs: DataFrame, limit: int = SUMMARY_TOKENS, depth: int = DEPTH, counter: Callable[[Column], Column] = count_tokens) -> DataFrame:
    """(doc_id, section, content, path, title, tokens): the whole text up to `limit` tokens, else its parts; what stands before the first
    heading of a level that is cut is left out. counter: as in text_chunks()."""
    kept = dealt(_fragments(_section_lists(docs, counter), lambda tokens: tokens > limit, depth, counter)).filter("keep and not blank")
    return kept.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("n")).alias("section"), "content", "path", F.substring_index("path", " --> ", -1).alias("title"), "tokens")


def top_level_sections(docs: DataFrame) -> DataFrame:
    """(doc_id, section, content, title, path): texts cut at headings of level 1, or 2 if there are none, or whole; the path is the title."""
    by_doc = Window.partitionBy("doc_id")
    lines = classify_lines(docs)
    level = F.when(F.max((F.col("level") == 1).cast("int")).over(by_doc) == 1, 1).when(F.max((F.col("level") == 2).cast("int")).over(by_doc) == 1, 2)
    lines = lines.withColumn("_cut", level).withColumn("section", F.sum((F.col("level") == F.coalesce("_cut", F.lit(0))).cast("int") * F.col("_cut").isNotNull().cast("int")).over(by_doc.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))
    kept = lines.filter("_cut is null or section > 0")
    whole = F.when(F.col("is_last"), F.col("line")).otherwise(F.concat("line", F.lit("\n")))
    found = kept.groupBy("doc_id", "section").agg(_in_order(F.col("n"), whole).alias("content"), F.min_by(F.when(F.col("_cut").isNotNull(), F.col("head")), "n").alias("title"), F.bool_and(F.col("kind") == "blank").alias("blank"))
    title = F.coalesce("title", F.lit(""))
    return found.filter("not blank").select("doc_id", F.greatest("section", F.lit(1)).alias("section"), "content", title.alias("title"), title.alias("path"))


def union_chunks(texts: DataFrame, tables: DataFrame) -> DataFrame:
    """Text chunks and table chunks in one table (doc_id, chunk_index, type, needs_summary, tokens, path, content, start, end, is_table);
    a table's chunk_index is its table_index. Both come by document, so that what follows by it shuffles no text chunk again."""
    columns = ["doc_id", "chunk_index", "type", "needs_summary", "tokens", "path", "content", "start", "end", "is_table"]
    t = tables.withColumns({"chunk_index": F.col("table_index"), "type": F.lit("Table"), "needs_summary": F.lit(False), "is_table": F.lit(True)})
    return dealt(texts.withColumn("is_table", F.lit(False)).select(columns)).unionByName(dealt(t.select(columns)))


def _inside(chunks: DataFrame) -> DataFrame:
    """union_chunks() with `inside`: text chunks that a table of their document contains. A table's end is inclusive, a text's isn't.

    Of the tables that start no later than a chunk, the one that ends last decides: a running maximum, no join of intervals.
    """
    w = Window.partitionBy("doc_id").orderBy("start", F.desc("is_table"), "chunk_index").rowsBetween(Window.unboundedPreceding, 0)
    return chunks.withColumn("inside", ~F.col("is_table") & F.coalesce(F.col("end") <= F.max(F.when(F.col("is_table"), F.col("end"))).over(w), F.lit(False)))


def chunks_inside_tables(texts: DataFrame, tables: DataFrame) -> DataFrame:
    """(doc_id, chunk_index) of text chunks that a table of their document contains."""
    places = ["doc_id", "start", "end"]
    t = tables.select(*places, F.lit(0).alias("chunk_index"), F.lit(True).alias("is_table"))
    return _inside(texts.select(*places, "chunk_index", F.lit(False).alias("is_table")).unionByName(t)).filter("inside").select("doc_id", "chunk_index")


def is_trivial(content: Column) -> Column:
    """Whether every line of a content is blank, a heading, a rule or part of HTML."""
    # most contents have no tag, and most of these a line that tells at once
    blocks = F.transform(F.split(content, r"\n[ \t]*(?=\n|$)"), lambda b: F.regexp_replace(b, r"(?s)(^|\n) {0,3}<[A-Za-z/!?].*$", ""))
    rest = F.flatten(F.transform(blocks, lambda b: F.split(b, "\n")))
    tagged = F.forall(rest, lambda x: (F.trim(x) == "") | x.rlike(r"^ {0,3}#{1,6}([ \t]|$)") | x.rlike(r"^ {0,3}([-*_])[ \t]*(\1[ \t]*){2,}$"))
    return F.when(content.contains("<"), tagged).otherwise(~content.rlike(_TELLING))


def _joined(chunks: DataFrame, keep) -> DataFrame:
    own = F.struct("type", "needs_summary", "path", "start", "end", "chunk_index")
    found = chunks.groupBy("doc_id", "is_table", "_island").agg(_in_order(F.col("chunk_index"), F.col("content"), "\n").alias("content"), F.sum("tokens").alias("tokens"), keep(own, "chunk_index").alias("own"))
    return found.select("doc_id", "is_table", "content", "tokens", "own.*")


def merge_inside_tables(chunks: DataFrame) -> DataFrame:
    """union_chunks() after text chunks inside a table joined the chunk before; a document's first chunk never does."""
    w = Window.partitionBy("doc_id", "is_table").orderBy("chunk_index")
    t = _inside(chunks).withColumn("_first", F.row_number().over(w) == 1)
    t = t.withColumn("_island", F.sum((~F.col("inside") | F.col("_first")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return _joined(t, F.min_by)


def merge_trivial_forward(chunks: DataFrame) -> DataFrame:
    """union_chunks() after text chunks of headings only joined the chunk after; a document's last chunk stays."""
    ahead = Window.partitionBy("doc_id", "is_table").orderBy(F.desc("chunk_index"))
    t = chunks.withColumns({"_alone": ~F.col("is_table") & is_trivial(F.col("content")), "_last": F.row_number().over(ahead) == 1})
    t = t.withColumn("_island", F.sum((~F.col("_alone") | F.col("_last")).cast("int")).over(ahead.rowsBetween(Window.unboundedPreceding, 0)))
    return _joined(t, F.max_by)


def merge_and_reindex(texts: DataFrame, tables: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Text chunks inside a table join the chunk before, heading-only chunks the chunk after; what then exceeds max_tokens needs a
    summary; chunks are numbered for each type and ordered by where they started."""
    t = merge_trivial_forward(merge_inside_tables(union_chunks(texts, tables)))
    t = t.withColumn("needs_summary", ~F.col("is_table") & (F.col("needs_summary") | (F.col("tokens") > max_tokens)))
    t = t.withColumn("type", F.when(F.col("needs_summary"), "Summary").otherwise(F.col("type")))
    index = F.row_number().over(Window.partitionBy("doc_id", "type").orderBy("chunk_index"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "is_table", "chunk_index"))
    return t.withColumns({"place": place, "_index": index}).select("doc_id", "type", "needs_summary", "tokens", "path", "content", "start", "end", F.col("_index").alias("chunk_index"), "place")


def chunk_type_counts(chunks: DataFrame) -> DataFrame:
    """(doc_id, n_text, n_table, n_summary, n_tokens) of every document with chunks, and of all of them in a row without doc_id."""
    counts = [F.count_if(F.col("type") == k).alias(f"n_{k.lower()}") for k in ("Text", "Table", "Summary")]
    per_doc = chunks.filter("doc_id is not null").rollup("doc_id")
    return per_doc.agg(*counts, F.sum("tokens").alias("n_tokens"))

"""Markdown texts as tables of lines: place, kind, heading level."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# the mark that opened a fence closes it, as often or more often; without one the fence lasts to the end
_FENCE = r"(?dm)^ {0,3}(```|~~~)"
_FENCED = r"(?dm)^ {0,3}(?:(`{3,})[^`\n]*|(~{3,})[^\n]*)$(?s:.*?)(?:^ {0,3}(?:\1`*|\2~*)[ \t\r]*$|\z)"
_HTML = r"^ {0,3}<[A-Za-z/!?]"
_DELIMITER = r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$"
_UNDERLINE = r"^ {0,3}(=+|-+)[ \t\r]*\z"
_SOME_UNDERLINE = r"(?dm)^ {0,3}(=+|-+)[ \t\r]*$"
_INDENTED = r"^(?: {4}| {0,3}\t)"


def count_tokens(text: Column) -> Column:
    """Runs of characters that aren't white space. They add up over lines; with a sub-word counter chunking counts each part again."""
    return F.regexp_count(text, F.lit(r"\S+")).cast("long")


def _marked_lines(text: Column) -> Column:
    """An array of structs (line, code) of a text's lines, code telling those of fenced blocks with their fences."""
    plain = lambda lines: F.transform(lines, lambda x: F.struct(x.alias("line"), F.lit(False).alias("code")))
    between, code = F.split(text, _FENCED), F.regexp_extract_all(text, F.lit(_FENCED), F.lit(0))
    last = F.size(between) - 1

    def part(x: Column, i: Column) -> Column:
        # what stands between two blocks begins and ends with a newline that belongs to neither of its lines
        front, back = (i > 0).cast("int"), (i < last).cast("int")
        inner = F.substr(x, front + 1, F.greatest(F.length(x) - front - back, F.lit(0)))
        none = (last > 0) & F.when((i > 0) & (i < last), F.length(x) < 2).otherwise(x == "")
        lines = F.when(none, F.array().cast("array<string>")).otherwise(F.split(inner, "\n"))
        fenced = F.transform(F.coalesce(F.split(F.get(code, i), "\n"), F.array().cast("array<string>")), lambda y: F.struct(y.alias("line"), F.lit(True).alias("code")))
        return F.concat(plain(lines), fenced)

    return F.when(text.rlike(_FENCE), F.flatten(F.transform(between, part))).otherwise(plain(F.split(text, "\n")))


def dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt out by doc_id to twice as many tasks as spark.sql.shuffle.partitions says.

    Lines with their marks are many times as large as what is shuffled, by whose size adaptive execution would give a task more than it
    can sort in memory. (To just as many tasks, Spark would leave the exchange out where rows come by doc_id already, and put tasks together.)
    """
    return rows.repartition(2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")


def left_joined(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """left.join(right, on, "left") with rows dealt out by the first of `on` alone: what follows by that column needs no other exchange.

    A join by several columns would deal rows out by all of them, and what follows by the first once more. Rows of both sides meet in
    groups instead; keys may repeat, and null ones meet no one.
    """
    sides = {"_left": left, "_right": right}
    others = {k: F.struct(*(c for c in df.columns if c not in on)).alias(k) for k, df in sides.items()}
    rows = left.select(*on, others["_left"]).unionByName(right.dropna(subset=on).select(*on, others["_right"]), allowMissingColumns=True)
    dealt = rows.repartition(2 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), on[0])
    met = dealt.groupBy(*on).agg(*(F.collect_list(k).alias(k) for k in sides)).select(*on, F.explode("_left").alias("_left"), "_right")
    return met.select(*on, "_left", F.explode_outer("_right").alias("_right")).select(*on, "_left.*", "_right.*")


def split_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, n, start, line, is_last, code, under): lines from 1, with the place of their first character. Null texts have none.

    code: within a fenced block; under: the next line if that underlines a title, else null. Whole texts are dealt out, not their lines.
    """
    each = dealt(docs.filter("text is not null").select("doc_id", "text")).select("doc_id", "text", _marked_lines(F.col("text")).alias("l"))
    below = lambda i: F.get("l", i + 1)["line"]
    marked = F.transform("l", lambda x, i: F.struct(x["line"].alias("line"), x["code"].alias("code"), F.when(below(i).rlike(_UNDERLINE), below(i)).alias("under")))
    unmarked = F.transform("l", lambda x: F.struct(x["line"].alias("line"), x["code"].alias("code"), F.lit(None).cast("string").alias("under")))
    opened = each.select("doc_id", F.posexplode(F.when(F.col("text").rlike(_SOME_UNDERLINE), marked).otherwise(unmarked)).alias("_i", "l"))
    rows = opened.select("doc_id", (F.col("_i") + 1).alias("n"), "l.*")
    # the place of a line is the length of those before it, with their newlines
    by_doc = Window.partitionBy("doc_id").orderBy("n")
    length = F.length("line") + 1
    return rows.withColumns({"start": (F.sum(length).over(by_doc.rowsBetween(Window.unboundedPreceding, 0)) - length).cast("long"), "is_last": F.lead("n").over(by_doc).isNull()})


def classify_lines(docs: DataFrame, counter: Callable[[Column], Column] = count_tokens) -> DataFrame:
    """(doc_id, n, start, line, is_last, kind, level, head, tokens): kind is heading, table, html, rule, list, code, quote, paragraph or
    blank; level that of a heading, at its first line, else 0; head the text of a heading, at its first line.

    A fence opens code up to a fence of its own mark; four blanks after a blank line or a heading open code too, unless a list goes on.
    A line that begins with a tag opens HTML up to a blank line; lines with bars are a table if the second of them is a row of dashes;
    a row of = or - below a line of text makes both a heading (of a longer paragraph, its last line). counter: tokens of a
    text, taken of each line here.
    """
    by_doc = Window.partitionBy("doc_id").orderBy("n")
    so_far = by_doc.rowsBetween(Window.unboundedPreceding, 0)
    line, code = F.col("line"), F.col("code")
    rows = split_lines(docs).withColumns({"blank": ~code & ~line.rlike(r"\S"), "_tag": ~code & line.rlike(_HTML)})
    rows = rows.withColumns({"_blank_at": F.max(F.when(F.col("blank"), F.col("n"))).over(so_far), "_html_at": F.max(F.when(F.col("_tag"), F.col("n"))).over(so_far)})
    rows = rows.withColumn("html", ~code & ~F.col("blank") & F.coalesce(F.col("_html_at") > F.coalesce("_blank_at", F.lit(0)), F.lit(False)))
    rows = rows.withColumn("_bar", ~code & ~F.col("html") & line.contains("|"))
    rows = rows.withColumns({"_before": F.coalesce(F.lag("_bar").over(by_doc), F.lit(False)), "_dashes": F.coalesce(F.lead(F.col("_bar") & line.rlike(_DELIMITER)).over(by_doc), F.lit(False))})
    opens = F.when(F.col("_bar") & ~F.col("_before"), F.col("_dashes"))
    rows = rows.withColumn("_table", F.col("_bar") & F.last(opens, ignorenulls=True).over(so_far))
    marks = F.length(F.regexp_extract(line, r"^ {0,3}(#{1,6})(?:[ \t]|$)", 1))
    kind = (
        F.when(code, "code")
        .when(F.col("blank"), "blank")
        .when(F.col("html"), "html")
        .when(F.col("_table"), "table")
        .when(marks > 0, "heading")
        .when(line.rlike(r"^ {0,3}([-*_])[ \t]*(\1[ \t]*){2,}$"), "rule")
        .when(line.rlike(r"^ {0,3}([-*+]|\d{1,9}[.)])([ \t]|$)"), "list")
        .when(line.rlike(r"^ {0,3}>"), "quote")
        .when(line.rlike(_INDENTED), "indented")
        .otherwise("paragraph")
    )
    rows = rows.withColumn("kind", kind)
    flush = F.col("kind") != "indented"
    title = (F.col("kind") == "paragraph") & F.col("under").isNotNull() & ~line.rlike(_UNDERLINE)
    rows = rows.withColumns({
        "_title": title,
        "_below": F.coalesce(F.lag(title).over(by_doc), F.lit(False)),
        "_above": F.last(F.when(flush, F.col("kind")), ignorenulls=True).over(so_far),
        "_text": F.last(F.when(flush & ~F.col("blank"), F.col("kind")), ignorenulls=True).over(so_far),
    })
    goes_on = F.when(F.col("_text") == "list", "list").when(F.col("_above").isin("paragraph", "quote"), F.col("_above")).otherwise("code")
    found = F.when(F.col("_title") | F.col("_below"), "heading").when(flush, F.col("kind")).otherwise(goes_on)
    level = F.when(F.col("_title"), F.when(F.col("under").contains("="), 1).otherwise(2)).when(F.col("kind") == "heading", marks).otherwise(0)
    head = F.when(F.col("_title"), F.concat(line, F.lit("\n"), "under")).when(F.col("kind") == "heading", line)
    return rows.select("doc_id", "n", "start", "line", "is_last", found.alias("kind"), level.alias("level"), head.alias("head"), counter(line).alias("tokens"))


def heading_path(lines: DataFrame) -> DataFrame:
    """lines with path: the enclosing headings of each line, joined by ` --> `; a heading ends those of its level and deeper ones."""
    so_far = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    at = {f"_at{k}": F.max(F.when(F.col("level") == k, F.col("n"))).over(so_far) for k in range(1, 7)}
    title = {f"_t{k}": F.last(F.when(F.col("level") == k, F.col("head")), ignorenulls=True).over(so_far) for k in range(1, 7)}
    shown = [F.when(F.col(f"_at{k}") > F.greatest(F.lit(0), F.lit(0), *(F.coalesce(f"_at{j}", F.lit(0)) for j in range(1, k))), F.col(f"_t{k}")) for k in range(1, 7)]
    return lines.withColumns({**at, **title}).withColumn("path", F.concat_ws(" --> ", *shown)).drop(*at, *title)

"""Lines, chunks and tables against small direct models."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docfoundry.operators import chunking, lines, tables


def tokens(s):
    return len(re.findall(r"\S+", s))


def level_of(line):
    m = re.match(r" {0,3}(#{1,6})(?:[ \t]|$)", line)
    return len(m[1]) if m else 0


RULE = r" {0,3}([-*_])[ \t]*(\1[ \t]*){2,}$"


def all_heads(text):
    """[(line number, place, level, heading)], titles over a row of = or - among them."""
    lines, at, out = text.split("\n"), 0, []
    for i, line in enumerate(lines):
        below = lines[i + 1] if i + 1 < len(lines) else ""
        if level_of(line):
            out.append((i, at, level_of(line), line))
        elif line.strip() and not re.match(RULE, line) and not re.match(r"=+$", line) and re.match(r" {0,3}(=+|-+)[ \t]*$", below):
            out.append((i, at, 1 if "=" in below else 2, f"{line}\n{below}"))
        at += len(line) + 1
    return out


def heads(text, level):
    return [(at, head) for _, at, k, head in all_heads(text) if k == level]


def trivial(text):
    of_heads = {i + k for i, _, _, head in all_heads(text) for k in range(head.count("\n") + 1)}
    return all(i in of_heads or not x.strip() or re.match(RULE, x) for i, x in enumerate(text.split("\n")))


def model_chunks(text, limit, level=1, path=(), base=0):
    """[content, tokens, needs_summary, path, start, end] by direct recursion."""
    if not text.strip():
        return []
    if tokens(text) < limit:
        return [] if trivial(text) else [[text, tokens(text), False, path, base, base + len(text)]]
    if level > 5:
        return [[text, tokens(text), True, path, base, base + len(text)]]
    found = heads(text, level)
    if not found:
        return model_chunks(text, limit, level + 1, path, base)
    out = model_chunks(text[: found[0][0]], limit, level + 1, path, base)
    waiting = []
    for (at, line), stop in zip(found, [a for a, _ in found[1:]] + [len(text)]):
        own = model_chunks(text[at:stop], limit, level + 1, (*path, line), base + at)
        if not own:
            waiting.append((at, line))
            continue
        if waiting:
            front = "\n".join(x for _, x in waiting)
            own[0][0] = front + "\n" + own[0][0]
            own[0][1] = tokens(own[0][0])
            own[0][4] = base + waiting[0][0]
            waiting = []
        out += own
    if waiting and out:
        out[-1][0] = "\n".join(x for _, x in waiting) + "\n" + out[-1][0]
        out[-1][1] = tokens(out[-1][0])
        out[-1][5] = base + waiting[-1][0] + len(waiting[-1][1])
    return out


def model_sections(text, limit, level=1, path=()):
    if tokens(text) <= limit or level > 5:
        return [(text, path)]
    found = heads(text, level)
    if not found:
        return model_sections(text, limit, level + 1, path)
    out = []
    for (at, line), stop in zip(found, [a for a, _ in found[1:]] + [len(text)]):
        out += model_sections(text[at:stop], limit, level + 1, (*path, line))
    return out


def random_markdown(rng):
    out = []
    for _ in range(rng.randint(1, 30)):
        kind = rng.random()
        if kind < 0.45:
            out.append("#" * rng.randint(1, 6) + " " + rng.choice(["A", "B c", "Long title here"]))
        elif kind < 0.55:
            out.append(rng.choice(["", "---", "===", "  "]))
        else:
            out.append(" ".join(rng.choice("abc") for _ in range(rng.randint(1, 9))))
    return "\n".join(out) + rng.choice(["", "\n", "\n\n"])


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    return ["", "  \n", "# only", "# a\n## b\n", "one two three", "# a\nx " + "y " * 40, *(random_markdown(rng) for _ in range(400))]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([*enumerate(texts), (10**6, None)], "doc_id long, text string").repartition(4).cache()


@pytest.mark.parametrize("limit", [5, 12, 40])
def test_text_chunks(docs, texts, limit):
    got = {}
    for r in chunking.text_chunks(docs, limit).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r["doc_id"], []).append([r["content"], r["tokens"], r["needs_summary"], r["path"], r["start"], r["end"]])
    for i, t in enumerate(texts):
        want = [[c, n, s, " --> ".join(p), a, b] for c, n, s, p, a, b in model_chunks(t, limit)]
        assert got.get(i, []) == want, repr(t)


def test_another_counter_of_tokens(spark):
    docs = spark.createDataFrame([(1, "# a\nbb cc\n# d\nee")], "doc_id long, text string")
    letters = lambda text: F.length(F.regexp_replace(text, r"\s", "")).cast("long")
    got = [(r["content"], r["tokens"]) for r in chunking.text_chunks(docs, 6, counter=letters).orderBy("chunk_index").collect()]
    assert got == [("# a\nbb cc\n", 6), ("# d\nee", 4)]


@pytest.mark.parametrize("limit", [6, 25])
def test_summary_sections(docs, texts, limit):
    got = {}
    for r in chunking.summary_sections(docs, limit).orderBy("doc_id", "section").collect():
        got.setdefault(r["doc_id"], []).append((r["content"], r["path"]))
    for i, t in enumerate(texts):
        want = [(c, " --> ".join(p)) for c, p in model_sections(t, limit)] if t.strip() else []
        assert got.get(i, []) == want, repr(t)


def test_top_level_sections(docs, texts):
    got = {}
    for r in chunking.top_level_sections(docs).orderBy("doc_id", "section").collect():
        got.setdefault(r["doc_id"], []).append((r["content"], r["title"]))
    for i, t in enumerate(texts):
        found = heads(t, 1) or heads(t, 2)
        want = [(t[a:b], h) for (a, h), b in zip(found, [a for a, _ in found[1:]] + [len(t)])] if found else [(t, "")] if t.strip() else []
        assert got.get(i, []) == want, repr(t)


def test_line_kinds(spark):
    text = "\n".join(["# T", "", "| a | b |", "|---|:-:|", "| 1 | 2 |", "a | b", "", "```", "# no | x", "```", "<table>", "<tr><td>1</td></tr>", "", "x | y", "- item", "1. item", "> q", "***", "####### seven", "#tag"])
    got = [r["kind"] for r in lines.classify_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("n").collect()]
    assert got == ["heading", "blank", "table", "table", "table", "table", "blank", "code", "code", "code", "html", "html", "blank", "paragraph", "list", "list", "quote", "rule", "paragraph", "paragraph"]


def test_titles_fences_and_indents(spark):
    cases = {
        "Title\n=====\ntext": ["heading", "heading", "paragraph"],
        "a\nTitle\n---\n---": ["paragraph", "heading", "heading", "rule"],
        "~~~\n```\n# no\n~~~\n# yes": ["code"] * 4 + ["heading"],
        "````\n```\n````\n\n```x\n": ["code"] * 3 + ["blank", "code", "code"],
        "\n\n```\na\n```\n\n~~~\nb\n~~~\n~~~\n~~~": ["blank", "blank", "code", "code", "code", "blank", *["code"] * 5],
        "x\n\n    code\n    more\n\n- a\n\n    b\n\nx\n    y": ["paragraph", "blank", "code", "code", "blank", "list", "blank", "list", "blank", "paragraph", "paragraph"],
    }
    found = lines.classify_lines(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).collect()
    for i, (text, want) in enumerate(cases.items()):
        own = sorted((r for r in found if r["doc_id"] == i), key=lambda r: r["n"])
        assert [r["kind"] for r in own] == want, text
        assert [r["line"] for r in own] == text.split("\n") and all(text[r["start"] :].startswith(r["line"]) for r in own)


def test_heading_path(spark):
    d = spark.createDataFrame([(1, "x\n# A\n### C\ny\n## B\nz\n# D\nw")], "doc_id long, text string")
    got = [r["path"] for r in lines.heading_path(lines.classify_lines(d)).orderBy("n").collect()]
    assert got == ["", "# A", "# A --> ### C", "# A --> ### C", "# A --> ## B", "# A --> ## B", "# D", "# D"]


def model_merge(text, table, limit):
    text = [list(x) for x in text]
    for i in range(len(text) - 1, 0, -1):
        if any(text[i][2] >= a and text[i][3] <= b for a, b in table):
            text[i - 1][0] += "\n" + text[i][0]
            text[i - 1][1] += text[i][1]
            del text[i]
    for i in range(len(text) - 2, -1, -1):
        if trivial(text[i][0]):
            text[i + 1][0] = text[i][0] + "\n" + text[i + 1][0]
            text[i + 1][1] += text[i][1]
            del text[i]
    return [(c, n, n > limit) for c, n, _, _ in text]


def test_merge_and_reindex(spark):
    rng = random.Random(9)
    texts, tabs, want = [], [], {}
    for d in range(200):
        at, own, spans = 0, [], []
        for i in range(rng.randint(1, 8)):
            size = rng.randint(2, 9)
            own.append([rng.choice(["# h", "word", "# h\n---", "a b c"]), rng.randint(1, 6), at, at + size])
            at += size
        for i in range(rng.randint(0, 2)):
            a = rng.randint(0, at)
            spans.append((a, a + rng.randint(3, 20)))
        texts += [(d, i + 1, "Text", False, n, "", c, a, b) for i, (c, n, a, b) in enumerate(own)]
        tabs += [(d, i + 1, 5, "", "t", a, b) for i, (a, b) in enumerate(spans)]
        want[d] = model_merge(own, spans, 9)
    t = spark.createDataFrame(texts, "doc_id long, chunk_index int, type string, needs_summary boolean, tokens long, path string, content string, start long, end long")
    tb = spark.createDataFrame(tabs, "doc_id long, table_index int, tokens long, path string, content string, start long, end long")
    got = chunking.merge_and_reindex(t, tb, 9).collect()
    for d in want:
        own = sorted((r for r in got if r["doc_id"] == d and r["type"] != "Table"), key=lambda r: r["place"])
        assert [(r["content"], r["tokens"], r["needs_summary"]) for r in own] == want[d]
        places = sorted((r for r in got if r["doc_id"] == d), key=lambda r: r["place"])
        assert [r["start"] for r in places] == sorted(r["start"] for r in places)
        for kind in ("Text", "Table", "Summary"):
            of = [r["chunk_index"] for r in places if r["type"] == kind]
            assert sorted(of) == list(range(1, len(of) + 1))


def py_dice(a, b):
    x, y = ({s[i : i + 2] for i in range(len(s) - 1)} for s in (a, b))
    return 1.0 if a == b else 2 * len(x & y) / (len(x) + len(y)) if x and y else 0.0


def py_cell(a, b):
    a, b = a.strip().lower(), b.strip().lower()
    return 0.0 if not a or not b else 1.0 if a == b else 0.8 if a in b or b in a else 0.6 if py_dice(a, b) >= 0.6 else 0.0


def py_table(t, u):
    n, m = len(t[1]), len(u[1])
    head = sum(py_cell(x, y) for x, y in zip(t[1], u[1])) / min(n, m) * (min(n, m) / max(n, m)) if n and m else 0.0
    col = 1.0 if t[0] == u[0] else 0.4 if abs(t[0] - u[0]) == 1 else 0.0
    return (0.8 * head if t[2] and u[2] else 0.7 if t[2] else 0.1 if u[2] else 0.5 + 0.2 * col) + 0.2 * col


def test_similarities(spark):
    pairs = [("Mô tả", "Mô t ả", 2 * 3 / 9), ("ab", "ab", 1.0), ("a", "b", 0.0), ("abcd", "bcde", 4 / 6), ("", "x", 0.0)]
    got = spark.createDataFrame(pairs, "a string, b string, want double").select(tables.dice(F.col("a"), F.col("b")).alias("got"), "want").collect()
    assert all(abs(r["got"] - r["want"]) < 1e-9 for r in got)


@pytest.mark.parametrize("policy", ["split", "merge"])
def test_table_segments(spark, policy):
    rng = random.Random(2)
    rows, want, answers = [], {}, []
    for d in range(150):
        refs, seg = [], 0
        for i in range(rng.randint(1, 9)):
            cells = [rng.choice(["Name", "name ", "Amount", "Amounts", "Total sum", "Qty", ""]) for _ in range(rng.randint(1, 4))]
            t = (len(cells), cells, rng.random() < 0.6)
            answer = rng.choice([None, "yes", "No", "Y"])
            if answer:
                answers.append((d, i, answer))
            scores = [py_table(r, t) for r in refs]
            sure = None if not scores else True if min(scores) >= 0.7 else False if max(scores) <= 0.25 else None
            merged = seg > 0 and (sure if sure is not None else answer.lower().startswith("y") if answer else policy == "merge")
            seg += not merged
            refs = (refs if merged else []) + ([t] if t[2] else [])
            rows.append((d, i, t[0], t[1], t[2]))
            want[d, i] = (seg, round(min(scores), 4) if scores and seg > 0 and (i > 0) else None)
    t = spark.createDataFrame(rows, "doc_id long, table_index int, column_count int, header_cells array<string>, has_header boolean")
    a = spark.createDataFrame(answers, "doc_id long, table_index int, answer string")
    for r in tables.table_segments(t, policy, a).collect():
        seg, least = want[r["doc_id"], r["table_index"]]
        assert r["segment"] == seg and (r["min_score"] == pytest.approx(least, abs=2e-4) if least is not None else r["min_score"] is None)


def test_nested_tables(spark):
    cases = ["a<table>b<table x='1'>c</table>d</table>e", "<table-x>q</table-x>", "</table><table>a<table>b</table>c</table>", "<TABLE/>x</TABLE>", "<table", "", "no"]

    def model(html):
        out, depth, i = [], 0, 0
        while i < len(html):
            m = re.compile(r"<table(?=[\s>/]|$)[^>]*>?", re.I).match(html, i)
            if m:
                depth += 1
                out.append("<table>" * (depth == 1))
                i = m.end()
            elif html[i : i + 8].lower() == "</table>":
                depth -= 1
                out.append("</table>" * (depth == 0))
                i += 8
            else:
                out.append(html[i] * (depth == 1))
                i += 1
        return "".join(out)

    rows = spark.createDataFrame([(c,) for c in cases], "html string").select("html", tables.strip_nested_tables(F.col("html")).alias("got")).collect()
    for r in rows:
        assert r["got"] == model(r["html"]), r["html"]
    assert rows[0]["got"] == "<table>bd</table>" and rows[1]["got"] == "" and rows[3]["got"] == "<table>x</table>"


def test_tables_in_texts(spark):
    text = "# T\n\n| Name | Amount |\n|---|---|\n| a | 1 |\n\nPage 2\n\n| Name | Amount |\n|---|---|\n| b | 2 |\n\n<table><tr><th>X</th></tr><tr><td><table><tr><th>q</th><th>r</th></tr></table></td></tr></table>\n\nend"
    ls = lines.classify_lines(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    got = tables.tables_of(ls).orderBy("table_index").collect()
    assert [(r["column_count"], r["header_cells"], r["has_header"], r["row_count"]) for r in got] == [(2, ["Name", "Amount"], True, 1)] * 2 + [(1, ["X"], True, 1)]
    chunks = tables.table_chunks(ls).orderBy("table_index").collect()
    assert [c["content"] for c in chunks] == [text[text.index("| Name") : text.index("| b | 2 |") + 9], text[text.index("<table>") : text.rindex("</table>") + 8]]
    assert [c["title"] for c in chunks] == ["# T", "# T"] and all(text[c["start"] : c["end"] + 1] == c["content"] for c in chunks)
    assert tables.remove_tables(ls).first()["text"] == "# T\n\n\n\nPage 2\n\n\n\n\n\nend"


def test_table_documents_keep_every_table(spark):
    from docfoundry.plans import structure
    from docfoundry.plans.registry import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    sections = F.size(F.regexp_extract_all("text", F.lit(r"(?m)^## Section (\d+)$"), F.lit(1)))
    got = structure.table_document(t).select(F.floor(F.col("doc_id") / 10**9).alias("customer"), sections.alias("n")).collect()
    want = {r["o_custkey"]: r["count"] for r in t.orders.groupBy("o_custkey").count().collect()}
    assert max(want.values()) > 12 and max(r["n"] for r in got) == 12
    assert {c: sum(r["n"] for r in got if r["customer"] == c) for c in want} == want
    assert tables.tables_of(lines.classify_lines(structure.table_document(t))).count() == t.orders.count()


def test_lines_come_in_tasks_that_adaptive_execution_leaves_alone(spark):
    """By the size of texts alone, adaptive execution put the lines of many documents into one task, whose sorts spilled."""
    docs = spark.range(64).groupBy(F.col("id").alias("doc_id")).agg(F.lit("| a |\n|---|\n| 1 |\nb").alias("text"))
    found = lines.classify_lines(docs)
    assert found.rdd.getNumPartitions() == 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    exchanges = [p for p in plan.split("\n") if "Exchange" in p]
    assert exchanges and all("line#" not in p for p in exchanges)
    assert found.count() == 64 * 4
    for made in (tables.remove_tables(found), chunking._sections(found), tables.table_chunks(found)):
        assert made.rdd.getNumPartitions() == 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_nested_tables_are_stripped_once(spark):
    """Each field of the struct named the stripped text anew, and each name stripped it again."""
    inner = "<table><tr><td>x</td><td>y</td><td>z</td></tr></table>"
    texts = [f"<table><tr><th>a</th><th>b{inner}</th></tr><tr><td>1</td></tr></table>", "<table><tr><td>1</td></tr></table>", "<table><th>no row</table>", "", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, html string").select("i", tables.html_table_info(F.col("html")).alias("t"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("|</table>)") == 1
    got = {r.i: tuple(r.t) for r in df.collect()}
    assert got == {0: (2, ["a", "b"], True, 1), 1: (1, None, False, 1), 2: (0, None, True, 0), 3: (0, None, False, 0), 4: (0, None, None, None)}

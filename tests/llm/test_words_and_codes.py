"""Spelling variants, byte-pair encoding and vector codes, against plain Python over whole tables."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from docfoundry.llm import byte_pairs, common, queries, spelling, vector_codes

SF = "/root/testdata/sf0.01"


# --- spelling -------------------------------------------------------------------------------------------------------


def one_edit(word, alphabet):
    cut = {word[:i] + word[i + 1 :] for i in range(len(word))}
    put = {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in alphabet}
    other = {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in alphabet}
    return (cut | put | other) - {word}


def plain_words(docs, least=7):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            if h % 31 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            if len(low) >= least:
                counts[low] += 1
    return counts


def plain_variants(counts, times=10):
    """Every word with one deletion, insertion or replacement is looked up."""
    alphabet = sorted({c for w in counts for c in w})
    near = {w: [x for x in one_edit(w, alphabet) if x in counts] for w in counts}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def variants(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_op11_whole_query(spark):
    docs = [(r[0], r[1]) for r in common.table(spark, SF, "documents").select("doc_id", "text").collect()]
    counts = {w: n for w, n in plain_words(docs).items() if n >= 2}
    assert variants(queries.op11_spelling_variants(spark, SF)) == plain_variants(counts)


def test_variants_of_words_of_few_letters(spark):
    r = random.Random(5)
    counts = {}
    for k in range(250):
        w = "".join(r.choice("abcé") for _ in range(r.randint(1, 9)))
        counts[w] = r.choice([2, 3, 20, 30, 300, 4000])
    for w in list(counts)[:100]:
        i = r.randrange(len(w))
        counts[w[:i] + w[i + 1 :] or "z"] = 2
    counts |= {"a" * n: 5 for n in (1, 2, 3, 40, 41, 1000, 1001)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(7)
    assert variants(spelling.spelling_variants(df)) == plain_variants(counts)


def test_pairs_come_once(spark):
    words = ["abcdefgh", "abcdefg", "abcdefghi", "bbcdefgh", "abcdefhg", "xyz"]
    pairs = spelling.near_pairs(spark.createDataFrame([(w, 2) for w in words], "word string, n long")).select("a", "b").collect()
    assert sorted(tuple(sorted(p)) for p in pairs) == [("abcdefg", "abcdefgh"), ("abcdefg", "abcdefhg"), ("abcdefgh", "abcdefghi"), ("abcdefgh", "bbcdefgh")]


def test_words_are_never_broadcast(spark, tmp_path):
    # in a file they look as small as a broadcast may be; ten rows a word wouldn't fit the driver
    spark.createDataFrame([(f"{w}{e}", 2) for w in ("abcdefgh", "bcdefghi") for e in ("", "x", "yz")], "word string, n long").write.parquet(f"{tmp_path}/words")
    words = spark.read.parquet(f"{tmp_path}/words")
    for df in (spelling.near_pairs(words), spelling.spelling_variants(words)):
        assert df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_variants_of_odd_documents(spark):
    rows = [(1, None, "x", 1), (2, "", "x", 1), (None, "Worthless worthles worthless", "x", 1), (3, "wörTERbuch wörterbuch " * 20, None, None), (3, "wörTERbuch wörterbuch " * 20, None, None), (4, "Wörterbuche wörterbuche ÀÀÀÀÀÀÀÀ×÷ àààààààà 1", "y", 2), (5, "q" * 1_000, "", 0), (6, ("q" * 999 + " ") * 2, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n long")
    counts = {w: n for w, n in plain_words([(r[0], r[1]) for r in rows]).items() if n >= 2}
    assert variants(spelling.document_variants(docs)) == plain_variants(counts)
    assert spelling.document_variants(docs.limit(0)).collect() == []
    odd = spark.createDataFrame([(None, 3), ("", 2), ("word", None), ("words", 5)], "word string, n long")
    assert {(r["word"], r["n_near"], r["form"]) for r in spelling.spelling_variants(odd).collect()} == {(None, 0, None), ("", 0, None), ("word", 1, None), ("words", 1, None)}


# --- byte pairs -----------------------------------------------------------------------------------------------------

ODD = ["", None, " ", "a" * 20_000, "ab" * 3_000 + "é" * 2_000 + " " * 3_000 + "x", "don't 'tis ''s x's 'S\n\n  a  \t b", "日本語 テキスト 한국어", "\x1c\x1d \x85 a b", "<|endoftext|>", "\U0001f600‍" * 40]


def library():
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(byte_pairs.ranks_path(), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_op12_whole_query(spark):
    own = library()
    got = {r["doc_id"]: tuple(r) for r in queries.op12_byte_pairs(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    docs = common.table(spark, SF, "documents").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for i, text in docs:
        ids = own.encode_ordinary(text or "")
        packed = b"".join(x.to_bytes(4, "little") for x in ids)
        assert got[i] == (i, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def test_byte_pairs_of_odd_texts(spark):
    own, r = library(), random.Random(3)
    texts = [*ODD, *("".join(r.choice("abcdeABC 's1\n\t-é日") for _ in range(r.randint(0, 300))) for _ in range(500)), *("".join(r.choice("abcde") for _ in range(n)) for n in range(40, 200))]
    docs = spark.createDataFrame([*enumerate(texts), (None, "no id"), (0, "tie"), (0, "tie")], "doc_id long, text string").selectExpr("*", "1 as packed", "2 as decoded")
    out = docs.select("doc_id", "text", byte_pairs.encode(docs["text"]).alias("ids"))
    for row in out.select("text", "ids", byte_pairs.decode(out["ids"]).alias("back")).collect():
        assert row["ids"] == own.encode_ordinary(row["text"] or "") and bytes(row["back"]).decode() == (row["text"] or "")
    assert byte_pairs.tokens(docs).count() == len(texts) + 3
    assert byte_pairs.digests(docs.limit(0)).collect() == []


def test_a_worker_remembers_a_bounded_number_of_words():
    own = library()
    w = byte_pairs.Words(byte_pairs.ranks_path(), byte_pairs.public_pattern(), most=20)
    for k in range(30):
        text = " ".join(f"word{k}x{i % 7}" for i in range(k * 3)) + " the same zzqqj zzqqj"
        assert b"".join(x.to_bytes(4, "little") for x in own.encode_ordinary(text)) == w.encode([text, "", text])[2]
        assert len(w.known) <= 20 and len(w.older) <= 20


# --- vector codes ---------------------------------------------------------------------------------------------------


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * float(x)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = lambda v, k: v[k * width : (k + 1) * width]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    first = sorted(kept, key=lambda r: r[0])[:entries]
    books = [[cut(v, k) for _, v, _ in first] for k in range(parts)]
    nearest = lambda v, k: min((far(cut(v, k), e), j) for j, e in enumerate(books[k]))
    for _ in range(rounds):
        sums = defaultdict(list)
        for _, v, _ in kept:
            for k in range(parts):
                sums[k, nearest(v, k)[1]].append(cut(v, k))
        for (k, j), vs in sums.items():
            books[k][j] = [sum(c) // len(vs) for c in zip(*vs)]
    out, labels = [], Counter()
    for i, v, label in kept:
        got = [nearest(v, k) for k in range(parts)]
        out.append((i, "".join(f"{j:02x}" for _, j in got), sum(d for d, _ in got), label))
        labels[label] += out[-1][2]
    h = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((i, c, e, min(labels[label], (1 << 63) - 1), h) for i, c, e, label in out)


def coded(df):
    return sorted(tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


@pytest.mark.parametrize("n, dim, spread", [(300, 16, 1.0), (9, 8, 0.01), (300, 24, 2e5), (200, 16, 0.0003)])
def test_codes_against_plain_rounds(spark, n, dim, spread):
    r = random.Random(n)
    rows = [(i, [r.gauss(0, spread) for _ in range(dim)], r.choice([None, 1, 2])) for i in range(n)]
    rows[n // 2] = (n // 2, rows[0][1], 1)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as code", "2 as v").repartition(5)
    assert coded(vector_codes.vector_codes(df)) == plain_codes(rows)


def test_codes_with_wide_parts(spark):
    r = random.Random(8)
    rows = [(i, [r.gauss(0, 1) for _ in range(1024)], "x") for i in range(60)]
    assert coded(vector_codes.vector_codes(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string"))) == plain_codes([(r[0], r[1], r[2]) for r in spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").collect()])


def test_search_stops_only_where_nothing_nearer_can_be():
    import numpy as np

    r = np.random.default_rng(2)
    for _ in range(50):
        book = r.integers(-6, 7, (r.integers(1, 17), 4))
        parts = r.integers(-6, 7, (200, 4))
        index, far = vector_codes.Codebook(book).nearest(parts)
        all_far = ((parts[:, None] - book[None]) ** 2).sum(-1)
        assert (far == all_far.min(1)).all() and (index == all_far.argmin(1)).all()


def test_codes_of_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [0.5] * 8, 1), (1, [0.5] * 8, 1), (2, None, 1), (3, [nan] + [0.0] * 7, 1), (4, [None] + [0.0] * 7, 1), (5, [inf] * 8, 2), (6, [-0.1] * 8, None), (None, [0.7] * 8, None), (7, [1.0] * 5, 2), (8, [], 3), (9, [3e38] * 8, 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in vector_codes.vector_codes(df).collect()}
    assert set(got) == {1, 6, None, 7, 8, 9} and vector_codes.vector_codes(df).count() == 7
    assert got[7]["code"] is None and got[7]["error"] is None and got[8]["code"] is None and got[9]["error"] == 0
    assert got[None]["code"] == "00" * 8 and got[6]["label_error"] == got[None]["error"] + got[6]["error"]
    assert vector_codes.vector_codes(df.limit(0)).collect() == []
    assert [r["code"] for r in vector_codes.vector_codes(df.selectExpr("cast(null as long) as vec_id", "embedding", "label")).collect()] == [None] * 7

"""Operators that keep one row for each row, against plain Python over whole texts."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docfoundry.llm import common, licences, pieces, quality_qda, quality_rules, surrogates, textstats, url_filter

SF = "/root/testdata/sf0.01"
ODD = ["", None, "one", " ", "a a a a a a a a a", "x\n\nx\nx", "É é É\u3000é\x0b" * 30, "w" * 70_000 + " " + "y z " * 30_000, "|| ** a|b", "a\u2581b\u2581", "\n\nq", "\x00 \r\n t", "日本 語" * 9]


def odd(spark):
    rows = [(i, t, "x", i) for i, t in enumerate(ODD)] + [(None, "null id", None, None), (3, "tie", "x", 1), (3, "tie", "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, n_words long")


def documents(spark):
    return common.table(spark, SF, "documents")


def both(spark):
    return documents(spark).select("doc_id", "text").union(odd(spark).filter("text is null or text <> 'tie'").select(F.col("doc_id") + 10**9, "text"))


def by_id(rows):
    return {r["doc_id"]: r for r in rows if r["doc_id"] is not None}


def count_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(runs)
    hit = {i + k for i, r in enumerate(runs) if often[r] > 1 for k in range(8)}
    n, symbols = len(words), len(re.findall(r"[#*$%&|<>]", text or ""))
    return n, sum(map(len, words)), symbols, dup, len(hit), n < 20 or 100 * len(hit) > 30 * n


def test_quality_rules(spark):
    docs = both(spark)
    got = by_id(quality_rules.quality_rules(docs, common.table(spark, SF, "labels")).collect())
    for r in docs.filter("doc_id is not null").collect():
        q = got[r["doc_id"]]
        assert (*(q[c] for c in quality_rules.COUNTS), q["base_failed"]) == count_rules(r["text"]), r["doc_id"]
        assert 0 <= q["score"] <= 1 and q["kept"] == (not q["base_failed"] and q["score"] >= 0.3)


def test_columns_with_clashing_names_stay(spark):
    docs = documents(spark).withColumns({"_quality": F.lit("mine"), "q": F.lit(1), "d": F.lit(2), "kept": F.lit(False), "a.b": F.lit(3)})
    kept = quality_rules.keep_good(docs, common.table(spark, SF, "labels"))
    assert kept.columns == docs.columns and kept.filter("_quality = 'mine' and q = 1 and d = 2 and not kept and `a.b` = 3").count() == kept.count() > 100


@pytest.mark.parametrize("operator", [licences.licence_scan, pieces.digests, surrogates.pii, surrogates.replace_in])
def test_empty_tables_and_more_columns(spark, operator):
    one = spark.createDataFrame([(1, "cc by", "x", 5)], "doc_id long, text string, words string, ids int")
    assert operator(one.limit(0)).count() == 0
    plain, more = operator(one.select("doc_id", "text")).collect(), operator(one).collect()
    assert len(more) == 1 and all(more[0][c] == plain[0][c] for c in plain[0].asDict())


def test_url_filter_of_nothing_and_with_more_columns(spark):
    pages = spark.createDataFrame([(None, None, 1), (1, "http://a.com/x", 2)], "page_id long, url string, host int")
    assert url_filter.url_filter(pages.limit(0)).count() == 0
    assert sorted((r["page_id"] or 0, r["host"], r["rule"]) for r in url_filter.url_filter(pages).collect()) == [(0, "", None), (1, "a.com", "com/")]


def test_held_out_quality(spark):
    labels = common.table(spark, SF, "labels")
    for f, least in ((quality_rules.quality_rules, 0.93), (quality_qda.quality_classifier, 0.97)):
        r = f(documents(spark), labels).join(labels, "doc_id").filter("crc32(cast(doc_id as string)) % 5 = 0").select("quality", "score").toPandas()
        assert common.auc(r.quality.values, r.score.values) >= least


def test_scores_read_text_only(spark):
    docs, labels = documents(spark), common.table(spark, SF, "labels")
    other = docs.withColumns({"lang": F.lit("zz"), "source": F.lit("s"), "n_chars": F.lit(None).cast("long")})
    for f in (quality_rules.quality_rules, quality_qda.quality_classifier):
        assert sorted(f(docs, labels).select("doc_id", "score").collect()) == sorted(f(other, labels).select("doc_id", "score").collect())


def test_without_labels_or_rows(spark):
    docs, labels = odd(spark), spark.createDataFrame([], "doc_id long, quality int")
    for f in (quality_rules.quality_rules, quality_qda.quality_classifier):
        assert f(docs, labels).count() == docs.count()
        assert f(docs.limit(0), labels).count() == 0
    assert quality_rules.keep_good(docs, labels).columns == docs.columns


def test_discriminant_is_the_gaussian_one():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 3)) @ np.diag([1, 2, 3])
    y = (rng.random(4000) < 0.3).astype(float)
    x[y == 1] = x[y == 1] * 0.5 + 1
    m = quality_qda.fit(x, y, 0, 0)
    z = (x - m.centre) / m.scale
    want = []
    for c in (0, 1):
        s, mu = np.cov(z[y == c].T, bias=True), z[y == c].mean(0)
        want.append(-0.5 * (np.einsum("ij,jk,ik->i", z - mu, np.linalg.inv(s), z - mu) + np.linalg.slogdet(s)[1]))
    ok = (np.abs(z) < 8).all(1)
    assert np.allclose(m.difference(x)[ok], (want[1] - want[0])[ok])


def test_pieces_are_the_librarys(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    docs = both(spark)
    got = by_id(pieces.digests(docs).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in docs.filter("doc_id is not null").collect():
        ids = sp.encode(r["text"] or "")
        d = got[r["doc_id"]]
        assert (d["n_tokens"], d["ids_sha256"], d["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))), r["doc_id"]


def test_pieces_random():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    p = pieces.Pieces.at(pieces.model_path())

    @settings(max_examples=600, deadline=None)
    @given(st.text(st.sampled_from(" \n\t\u2581abeEthé0.日\x00<>\U0001f600"), max_size=40))
    def same(t):
        assert p.encode(t).tolist() == p.model.encode(t)

    same()


def test_scan_base(spark):
    docs = both(spark).union(spark.createDataFrame([(2 * 10**9, "CC BY cc by. All\nrights-reserved; ü general public license")], "doc_id long, text string"))
    got = by_id(licences.licence_scan(docs).collect())
    for r in docs.filter("doc_id is not null").collect():
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"] or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = [(i, label) for p, label in licences.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        g = got[r["doc_id"]]
        want = (len(words), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at})))
        assert (g["n_words"], g["n_base"], g["first_word"], g["last_word"], g["base_labels"]) == want
        labels, score = {x for _, x in at}, 0.0
        for line in low.split("\n"):
            held = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", line))
            for label, t in licences.TEMPLATES:
                c = len(held & set(t.split())) / len(set(t.split()))
                if c >= 0.8:
                    labels.add(label)
                    score = max(score, c)
        assert g["labels"] == ",".join(sorted(labels)) and g["score"] == pytest.approx(1.0 if at else score)


def test_wrapped_notices(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files"
    bsd = " * Redistribution and use in source and binary forms, with or without\r\n * modification, are permitted provided that the following conditions\r\n * are met:"
    cc0 = "\n".join("To the extent possible under law, the author has waived all copyright and related rights to this work.".split())
    far = "this source code form is\n" + "x " * 60 + "\nsubject to the terms of the mozilla public license v 2 0"
    texts = [mit, bsd, cc0, "w " * 301 + "\n" + mit + "\n" + "v " * 77, mit.replace("\n", "\n\n"), far, "q\n\n" + bsd + "\n\n" + cc0, "a\nb"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(licences.licence_scan(docs).collect())
    assert [got[i]["labels"] for i in range(len(texts))] == ["mit", "bsd", "cc0", "mit", "", "", "bsd,cc0", ""]
    assert [got[i]["score"] for i in range(len(texts))] == [1, 1, 1, 1, 0, 0, 1, 0]


def test_urls(spark):
    urls = ["http://A.Com/x?q", "nothing", None, "https://example.com/en/a#b", "https://www.Example.com/en/", "ftp://x.net/es/", "a://b.net/esx", "://net/fr/", "http://xexample.com/en/", "http://com", "http://é.org/路径", "x://y://z.com/", "http://h.org/" + "p" * 5000]
    pages = common.table(spark, SF, "pages").select("page_id", "url").union(spark.createDataFrame([(10**9 + i, u) for i, u in enumerate(urls)], "page_id long, url string"))
    got = {r["page_id"]: r for r in url_filter.url_filter(pages).collect()}
    for r in pages.collect():
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", r["url"] or "")
        host, path = (re.sub("[A-Z]", lambda c: c.group().lower(), m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        g = got[r["page_id"]]
        assert (g["host"], g["path"], g["rule"]) == (host, path, max(fits)[1] if fits else None), r["url"]
        assert g["verdict"] == (max(fits)[2] if fits else "block" if g["score"] >= 0.5 else "allow")


def test_url_scores_against_a_plain_model(spark):
    import xxhash

    w = url_filter.Weights([float(x) for x in np.random.default_rng(2).normal(size=256)], -0.3)
    pages = common.table(spark, SF, "pages").select("url")
    host, path = url_filter.host_and_path(F.col("url"))
    rows = pages.select(host.alias("h"), path.alias("p"), url_filter.block_score(host, path, w).alias("s")).collect()

    def buckets(tag, text):
        marked, seed = f"^{text}$", xxhash.xxh64_intdigest(tag.encode(), seed=42)
        for k in (3, 4):
            for i in range(len(marked) - k + 1):
                h = xxhash.xxh64_intdigest(marked[i : i + k].encode(), seed=seed)
                yield (h - (1 << 64) * (h >> 63)) % 256

    assert len(rows) > 100
    for r in rows:
        z = w.intercept + sum(w.by_bucket[b] for b in {*buckets("h", r["h"]), *buckets("p", r["p"])})
        assert abs(r["s"] - 1 / (1 + np.exp(-z))) < 1e-9


def test_url_model_learns_held_out_pages(spark):
    r = url_filter.url_filter(common.table(spark, "/root/testdata/sf0.1", "pages")).filter("rule is not null and crc32(cast(page_id as string)) % 5 = 0").toPandas()
    assert common.auc((r.verdict == "block").astype(int).values, r.score.values) >= 0.95


def test_surrogates(spark):
    text = 'Mail ann.34@mail7.example.com or ANN.34@mail7.example.com, +1 (826) 555-4081 or 826-555-4081; 97.51.17.173 4111111111111111 7536784127813050 token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8" 078-05-1120 DE89370400440532013000 Mrs. Anna Smith, Mr Zed Smith, Mrs. Anna Smith'
    docs = odd(spark).select("doc_id", "text").union(spark.createDataFrame([(100, text), (101, text.upper()), (102, "ann.34@mail7.example.com")], "doc_id long, text string"))
    found = surrogates.pii(docs)
    got = by_id(found.collect())
    e = got[100]["entities"]
    assert [x["kind"] for x in e] == ["email", "email", "phone", "phone", "ip", "card", "card", "secret", "ssn", "iban", "name", "name", "name"]
    originals = [text[x["start"] : x["start"] + x["length"]] for x in e]
    for x, o in zip(e, originals):
        assert x["surrogate"] != o and o not in got[100]["text"].replace(x["surrogate"], "")
        assert [c.isdigit() for c in x["surrogate"]] == [c.isdigit() for c in o] or x["kind"] in ("ip", "secret", "iban", "name")
    new = [x["surrogate"] for x in e]
    assert new[0].upper() == new[1].upper() and new[10] == new[12] and new[10].split()[0] in surrogates.GIVEN["latin", "female"]
    assert re.sub(r"\D", "", new[2])[-10:] == re.sub(r"\D", "", new[3])
    assert all(surrogates._luhn(new[i]) == surrogates._luhn(originals[i]) for i in (5, 6)) and surrogates._iban_check(new[9][:2], new[9][4:]) == new[9][2:4]
    assert got[102]["text"] == new[0] and surrogates.collisions(found).count() == 0
    clean = {r["doc_id"]: r["text"] for r in docs.filter("doc_id < 100").collect()}
    assert all(got[i]["text"] == t for i, t in clean.items())
    assert surrogates.replace_in(docs.withColumn("extra", F.lit(1))).columns == ["doc_id", "text", "extra"]


def test_mentions_of_a_person_stay_together(spark):
    text = "Smith called. Mrs Anna Smith met Anna Smith; Mrs Smith and Smith left. Prof. Dr. Jean-Luc O. Meyer-Lang saw Mr McAdam, Dr Meyer-Lang and Господин Иван Петров. Петров, A. Plan"
    gone = ["Smith", "Anna", "Jean", "Luc", "Meyer", "Lang", "McAdam", "Иван", "Петров"]
    docs = spark.createDataFrame([(1, text), (2, "Mr Smith"), (3, "no title: Anna Smith")], "doc_id long, text string")
    found = surrogates.pii(docs)
    got = by_id(found.collect())
    new = got[1]["text"]
    assert not any(w in new for w in gone)
    last, first = re.search(r"^(\w+) called\. Mrs (\w+) ", new).groups()
    assert new.startswith(f"{last} called. Mrs {first} {last} met {first} {last}; Mrs {last} and {last} left. Prof. Dr. ") and new.endswith(", A. Plan")
    assert got[2]["text"] == f"Mr {last}" and got[3]["text"] == f"no title: {first} {last}" and first in surrogates.GIVEN["latin", "female"]
    assert re.search(r"Prof\. Dr\. \S+ \S\. (\S+) saw", new)[1] == re.search(r", Dr (\S+) and", new)[1]
    assert surrogates.collisions(found).count() == 0


def test_names_in_other_letters():
    for text, gone in {
        "Mr Jean Éé": "Jean Éé",
        "Mrs Thérèse Lefèvre": "Thérèse Lefèvre é è",
        "Κυρία Μαρία Παπαδοπούλου": "Μαρία Παπαδοπούλου ύ",
        "John Smith came": "John Smith",
        "Dear Zoé Žižková,": "Zoé Žižková",
        "Г-жа Господин Фёдор Ёлкин": "Фёдор Ёлкин",
    }.items():
        new = surrogates.replace(text, b"k" * 16)[0]
        assert not any(w in new.split(" ", 1)[1 if text[0] in "MΚDГ" else 0] for w in gone.split()), (text, new)
        assert len(new.split()) == len(text.split()) and [w[0].isupper() for w in new.split()] == [w[0].isupper() for w in text.split()]
    assert surrogates.find("Dear Sir or Madam, order 1234567890123 is late. Paul said so.") == []


def test_random_texts_against_their_parts():
    """Texts put together from filler and values: what is found is what was put in, in place, and what stands between stays."""
    rng = np.random.default_rng(3)
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    make = {
        "email": lambda: f"ab{digits(2)}@mail{digits(1)}.example.com",
        "ip": lambda: ".".join(str(x) for x in rng.integers(1, 255, 4)),
        "card": lambda: "4" + digits(15),
        "phone": lambda: f"+1 ({rng.integers(200, 999)}) 555-{digits(4)}",
        "ssn": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        "hex": lambda: "a1" + "".join(rng.choice(list("0123456789abcdef"), 38)),
    }
    key = b"k" * 16
    for size in (0, 1, 7, 40, 3000):
        parts, want = ["begin"], []
        for _ in range(size):
            kind = rng.choice(list(make))
            value = make[kind]()
            want.append((kind, value))
            parts += [value, "filler, text\n(and more)"]
        text = "; ".join(parts)
        new, entities = surrogates.replace(text, key)
        assert [(e["kind"], text[e["start"] : e["start"] + e["length"]]) for e in entities] == want
        expected = text
        for e, (kind, value) in list(zip(entities, want))[::-1]:
            expected = expected[: e["start"]] + surrogates.surrogate(kind, value, key) + expected[e["start"] + e["length"] :]
        assert new == expected


def test_secrets_without_digits():
    hidden = ["password: correcthorse", "token = abcdefghij", "api_key: 'abcdefghij'"]
    for text in hidden:
        assert [k for _, _, k, _ in surrogates.find(text)] == ["secret"] and text[-7:] not in surrogates.replace(text, b"k" * 16)[0]
    assert surrogates.find("The secret: everything changes") == []


def test_neighbours_are_told_apart():
    text = "+1 (826) 555-4081 190.137.223.204 7536784127813050 4845168114407329 a.1@b.example.com 10.0.0.1, +33 1 23 45 67 89 (555) 123-4567 12"
    got = [(text[a:b], kind) for a, b, kind, _ in surrogates.find(text)]
    assert got == [("+1 (826) 555-4081", "phone"), ("190.137.223.204", "ip"), ("7536784127813050", "card"), ("4845168114407329", "card"), ("a.1@b.example.com", "email"), ("10.0.0.1", "ip"), ("+33 1 23 45 67 89", "phone"), ("(555) 123-4567", "phone")]


def test_permutations_move_everything():
    key = b"k" * 16
    for size in (2, 3, 10, 97, 1000):
        assert sorted(surrogates.permute(i, size, key, "t") for i in range(size)) == list(range(size))
        images = [surrogates.moved(i, size, key, "t") for i in range(size)]
        assert sorted(images) == list(range(size)) and all(i != y for i, y in enumerate(images))


def test_planted_values_go(spark):
    docs = documents(spark)
    found = surrogates.pii(docs)
    got = by_id(found.collect())
    planted = re.compile(r'[a-z]+\.\d+@mail\d\.example\.com|\+1 \(\d{3}\) 555-\d{4}|(?<![\w.])\d{16}(?!\w)|token = "[0-9a-f]+"|(?<![\w.])\d+\.\d+\.\d+\.\d+(?![\w.]\d)')
    n = 0
    for r in docs.collect():
        values = [m.group() for m in planted.finditer(r["text"])]
        n += len(values)
        assert not any(v in got[r["doc_id"]]["text"] for v in values)
        assert values or got[r["doc_id"]]["text"] == r["text"] or re.search("(?i)token =", r["text"]) or "@" in r["text"]
    assert n > 20 and surrogates.collisions(found).count() == 0
    assert len(textstats.STATISTICS) == 20

"""Spelling variants: words one edit apart, found by PartEnum signatures of their letters.

A word's letters are a binary vector: one place for each letter and each time it occurs. One replaced letter changes two places, one
inserted or deleted letter one place. Places are dealt to parts by a hash; two vectors that differ in at most k places agree in all parts
but k, so they share the signature of those parts. Words of one length (k = 2) and of neighbouring lengths (k = 1) have signatures of
their own. An edit also leaves the first half of the shorter word or the rest of it as it is, so each signature is taken once with either
half: that keeps apart what only shares letters, and no signature gathers many words. Signatures are joined by equality, and each pair is
verified on the words themselves.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from hashlib import blake2b
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, mix

_FIRST, _LAST = "À", "ÿ"
PARTS = {2: 3, 1: 2}  #: by the number of places that may differ: 3 signatures for words of one length, 2 for neighbouring lengths


def count_words(docs: DataFrame, least: int = 7, spoil: int = 31, held: int = 200_000) -> DataFrame:
    """(word, n): the runs of letters of all documents with how often each occurs, `least` code points or more.

    Letters are A-Z, a-z and U+00C0 to U+00FF; only A-Z is lower-cased. h being the crc32 of `<doc_id>:<run>`, a run whose h `spoil`
    divides loses its code point h modulo its length; a null doc_id is written as nothing there. Texts are taken whole; a null text has no
    runs; repeated rows count each; other columns are not read; an empty table gives none. A task holds counts of at most `held` words,
    and of one batch of texts, and hands them on when there are more.
    """
    run = re.compile(f"[a-z{_FIRST}-{_LAST}]{{{least},}}")

    def count(batches):
        found: Counter[str] = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not text:
                    continue
                start = zlib.crc32(f"{'' if i is None else i}:".encode())
                for w, n in Counter(run.findall(text.encode().lower().decode())).items():
                    h = zlib.crc32(w.encode(), start)
                    if h % spoil == 0:
                        k = h % len(w)
                        w = w[:k] + w[k + 1 :]
                        if len(w) < least:
                            continue
                    found[w] += n
            if len(found) > held:
                yield out()
                found.clear()
        if found:
            yield out()

    texts = bounded_batches(docs).select("doc_id", "text").filter("text is not null")
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def places(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, hash) of each place that a word's vector holds, by word."""
    sizes = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(words)), sizes)
    order = np.lexsort((points, of))
    of, points = of[order], points[order]
    first = np.ones(len(of), bool)
    first[1:] = (of[1:] != of[:-1]) | (points[1:] != points[:-1])
    at = np.arange(len(of))
    again = at - np.maximum.accumulate(np.where(first, at, 0))
    return of, mix((points << np.uint64(32)) + again.astype(np.uint64) + np.uint64(77))


def _halves(words: list[str], shorter: np.ndarray) -> list[np.ndarray]:
    """Hashes of the first half and of the rest, as many letters as the shorter word of a pair has; for the rest, counted from the end."""
    firsts = [w[: n // 2] for w, n in zip(words, shorter.tolist())]
    rests = [w[len(w) - (n - n // 2) :] for w, n in zip(words, shorter.tolist())]
    return [np.array([int.from_bytes(blake2b(x.encode(), digest_size=8, person=side).digest(), "little") for x in xs], np.uint64) for side, xs in ((b"first", firsts), (b"rest", rests))]


def signatures(words: list[str], longer: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, signature, places that may differ) of each row that a list of words gives; every word has one letter at least.

    Among neighbouring lengths a word is the shorter of a pair, or with `longer` the longer. Signatures hold the length of the shorter one.
    Different ones may be equal by chance: that costs a comparison, no more.
    """
    of, h = places(words)
    rows = []
    for differ, n in PARTS.items():
        sizes = np.array([len(w) for w in words], np.int64) - (longer and differ == 1)
        halves = _halves(words, sizes)
        sums = np.zeros((len(words), n), np.uint64)
        np.add.at(sums, (of, (mix(h + np.uint64(n)) % np.uint64(n)).astype(np.int64)), h)
        for k, kept in enumerate(combinations(range(n), n - differ)):
            key = mix(sizes.astype(np.uint64) + np.uint64((1000 * differ + k) << 32))
            for p in kept:
                key = mix(key + sums[:, p])
            for half in halves:
                rows.append((np.arange(len(words)), mix(key + half), np.full(len(words), differ, np.int8)))
    return tuple(np.concatenate(x) for x in zip(*rows))


def _signed(words: DataFrame, longer: bool) -> DataFrame:
    def sign(batches):
        for b in batches:
            for at in range(0, b.num_rows, 5000):
                part = b.slice(at, 5000)
                of, key, differ = signatures(part.column(0).to_pylist(), longer)
                take = pa.array(of)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(differ), part.column(0).take(take), part.column(1).take(take)], ["key", "differ", "word", "n"])

    return words.select("word", "n").mapInArrow(sign, "key long, differ byte, word string, n long")


def shuffled(df: DataFrame) -> DataFrame:
    """df, for a join that is not to broadcast it. Spark sizes it by the compressed files it comes from, and what Arrow functions make of
    rows as if they made one of each: a table that seems to take less than the 10 MB of a broadcast may take many times a driver's heap."""
    return df.hint("merge")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): each pair of words that differ by one inserted, deleted or replaced code point, once.

    words: (word, n), words distinct and not empty. Each word gives ten rows to either side of the join.
    """
    a, b = shuffled(_signed(words, False)).alias("a"), shuffled(_signed(words, True)).alias("b")
    met = (F.col("a.key") == F.col("b.key")) & (F.col("a.differ") == F.col("b.differ")) & ((F.col("a.differ") == 1) | (F.col("a.word") < F.col("b.word")))
    met = met & (F.levenshtein("a.word", "b.word", 1) == 1)
    return a.join(b, met).select(F.col("a.word").alias("a"), F.col("a.n").alias("a_n"), F.col("b.word").alias("b"), F.col("b.n").alias("b_n")).distinct()


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of each row (word, form): where forms lead, followed to the last. Each round doubles the steps taken; forms never
    lead in a circle, as each is more frequent than the word before."""
    at = scratch.keep(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while at.filter("moved").limit(1).count():
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = scratch.keep(shuffled(at.drop("moved")).join(shuffled(on), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
    return at.drop("moved")


def spelling_variants(words: DataFrame, times: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n of each row (word, n), words distinct.

    Two words are near if one inserted, deleted or replaced code point makes one the other. A word's form is its near word of largest n
    (ties: the smallest in code-point order), if that is at least `times` its own n; root is where forms lead, the word itself without one.
    Null and empty words are near none; null counts rank below all; other columns are dropped; an empty table gives none back.
    """
    scratch = Scratch(words.sparkSession)
    words = scratch.keep(words.select("word", F.col("n").cast("long").alias("n")), "words")
    found = near_pairs(words.filter("word <> ''"))
    ways = F.array(*(F.struct(F.col(x).alias("word"), F.col(y).alias("other"), F.col(f"{y}_n").alias("other_n")) for x, y in (("a", "b"), ("b", "a"))))
    both = found.select(F.explode(ways).alias("p")).select("p.*")
    first = F.min(F.struct((-F.coalesce("other_n", F.lit(-1))).alias("rank"), F.col("other").alias("form"), F.col("other_n").alias("form_n")))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), first.alias("first"))
    leads = F.col("first.form_n") >= times * F.col("n")
    out = shuffled(words).join(shuffled(near), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *(F.when(leads, F.col(f"first.{c}")).alias(c) for c in ("form", "form_n")))
    out = scratch.keep(out, "forms")
    led = roots(out.filter("form is not null"), scratch)
    return shuffled(out).join(shuffled(led), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def document_variants(docs: DataFrame, least: int = 7, occurrences: int = 2, spoil: int = 31, times: int = 10) -> DataFrame:
    """spelling_variants() of the words that count_words() finds at least `occurrences` times in the documents; odd rows as there."""
    return spelling_variants(count_words(docs, least, spoil).filter(F.col("n") >= occurrences), times)

"""Long personal values, collision checks, and selection by ids beside columns of any name."""

import random
import string

import pytest
from pyspark.sql import functions as F

from docfoundry.llm import common, jaccard_join, surrogates

KEY = b"k" * 32
LENGTHS = [8, 30, 64, 120, 128, 200, 255, 256, 257, 300, 511, 600, 1000, 2000]


def longest_run(flags):
    return max(map(len, "".join("x" if f else " " for f in flags).split()), default=0)


@pytest.mark.parametrize("alphabet", [string.digits, "0123456789abcdef", string.ascii_letters + string.digits + "_-"])
def test_no_part_of_a_long_secret_is_readable(alphabet):
    r = random.Random(1)
    first = kept_first = kept = total = 0
    for n in LENGTHS:
        for _ in range(8):
            value = "".join(r.choice(alphabet) for _ in range(n))
            new = surrogates.surrogate("secret", value, KEY)
            same = [a == b and a not in "_-" for a, b in zip(value, new)]
            assert len(new) == n and new != value and longest_run(same) <= 7  # a run of 8 by chance: once in 2,000 such tests
            kept, total, kept_first, first = kept + sum(same), total + n, kept_first + sum(same[: n // 2]), first + n // 2
    assert kept / total < 0.12 and kept_first / first < 0.12


@pytest.mark.parametrize("size", [2**64 - 59, 2**130 + 7, 62**120, 10**300 + 1])
def test_permutations_over_wide_ranges_come_back(size):
    r = random.Random(size)
    for x in [0, 1, size - 1, *(r.randrange(size) for _ in range(20))]:
        y = surrogates.permute(x, size, KEY, "t")
        assert surrogates.permute(y, size, KEY, "t", back=True) == x
        assert surrogates.moved(x, size, KEY, "t") != x


def test_values_that_differ_in_one_place_stay_distinct():
    base = "".join(random.Random(2).choice(string.ascii_lowercase + string.digits) for _ in range(700))
    values = {base} | {base[:i] + "q" + base[i + 1 :] for i in range(0, 700, 7)}
    assert len({surrogates.surrogate("secret", v, KEY) for v in values}) == len(values)


def test_long_tokens_and_addresses_in_texts():
    token = "eyJhbGciOiJIUzI1NiJ9." + "aB3" * 60 + "." + "x9Z" * 20
    new, found = surrogates.replace(f"token={token} mail {'jo' * 40}@example.com version 1.2.3.4", KEY)
    assert [e["kind"] for e in found] == ["secret", "email"] and new.endswith("version 1.2.3.4")
    assert not any(token[i : i + 8] in new for i in range(len(token) - 7)) and "jojojojo" not in new


def test_pii_fails_on_collisions(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "mail a@example.com"), (2, "mail b@example.com"), (None, None), (3, "")], "doc_id long, text string")
    assert surrogates.pii(docs, check=True).count() == 4
    faults = spark.createDataFrame([("email", "x@y.de", 2, "shared")], "kind string, value string, n long, fault string")
    monkeypatch.setattr(surrogates, "collisions", lambda found: faults)
    with pytest.raises(RuntimeError, match="collide"):
        surrogates.pii(docs, check=True)
    assert surrogates.pii(docs).count() == 4


CLASHING = ["_id", "wanted", "WANTED_", "spot", "_p", "bucket", "bits", "may", "_may", "a.b", "id"]


@pytest.mark.parametrize("few", [0, 200_000])
@pytest.mark.parametrize("keep", [True, False])
def test_select_ids_beside_columns_of_any_name(spark, few, keep):
    docs = spark.range(100).select(F.when(F.col("id") < 99, F.col("id")).alias("doc_id"), *(F.lit(f"own {c}").alias(c) for c in CLASHING))
    ids = spark.createDataFrame([(k,) for k in (3, 5, 98, 1000)], "x long")
    got = common.select_ids(docs, ids, keep=keep, broadcast_rows=few)
    assert got.columns == docs.columns
    rows = got.collect()
    assert {r["doc_id"] for r in rows} == ({3, 5, 98} if keep else {None, *range(99)} - {3, 5, 98})
    assert all(r[c] == f"own {c}" for r in rows for c in CLASHING)


def test_near_duplicates_beside_columns_of_any_name(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text), (2, text), (2, text), (3, "else"), (3, "where"), (None, text)], "doc_id long, text string")
    docs = docs.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHING))
    kept = jaccard_join.keep_first(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"] or 0, r["text"][:5]) for r in kept.collect()) == [(0, "w0 w1"), (1, "w0 w1"), (3, "else"), (3, "where")]
    assert all(r[c] == f"own {c}" for r in kept.collect() for c in CLASHING)

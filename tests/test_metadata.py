"""Metadata as columns over VARIANT, against the same rules on plain values."""

import json
import random

import pytest
from pyspark.sql import functions as F

from docfoundry.functions.text import folded
from docfoundry.operators import metadata

SCHEMA = {
    "type": "object",
    "additionalProperties": False,
    "required": ["kind", "year", "note", "none"],
    "properties": {
        "kind": {"type": "string", "enum": ["Report", "Báo cáo", "Đơn", "Letter"]},
        "year": {"oneOf": [{"type": "null"}, {"type": "integer"}]},
        "note": {"type": "string", "minLength": 1, "maxLength": 6},
        "none": {"type": ["string", "null"]},
        "when": {"type": "string", "format": "date"},
        "at": {"type": "string", "format": "date-time"},
        "ok": {"type": "boolean"},
        "amount": {"type": "number"},
        "level": {"enum": [1, 2.5, None, True, "x"]},
        "tags": {"type": "array", "items": {"type": "string"}},
        "who": {"type": "object", "required": ["name"], "additionalProperties": False, "properties": {"name": {"type": "string"}, "role": {"type": "string", "enum": ["Boss", "Élève"]}, "in": {"type": "object", "properties": {"n": {"type": "integer"}}}}},
    },
}
OTHER = {"properties": {"b": {"type": "integer"}, "c": {"type": "string", "enum": ["Ja", "Nein"]}}}
TEMPLATES = {"t": json.dumps(SCHEMA), "u": json.dumps(OTHER)}


def value(r, depth=0):
    pick = r.randrange(12)
    if pick == 0 and depth < 3:
        return {r.choice(["name", "role", "x", "in", "n", "a.b"]): value(r, depth + 1) for _ in range(r.randrange(4))}
    if pick == 1 and depth < 3:
        return [value(r, depth + 1) for _ in range(r.randrange(4))]
    return r.choice([None, "", "report", "BAO CAO", "đon", "Đơn", "other", "BOSS", "eleve", "2001", " 7 ", "x1", "2.5", "TRUE", "false", "2020-01-02", "2020-1-2", "2020-01-02T03:04", 0, 1, 7, 2.5, 3.0, -1e-7, True, False, "longer than six"])


def texts():
    r = random.Random(12)
    out = ["not json", "[]", "[1]", '"x"', "null", "7", "{}", '{"kind":"letter","year":1,"note":"a","none":null}', '{"who":{"role":"BOSS","name":"A"}}', '[{"kind":"letter"},{"who":[{"role":"boss"}]}]']
    for _ in range(250):
        keys = r.sample([*SCHEMA["properties"], "zz", "b", "c"], r.randrange(9))
        out.append(json.dumps({k: value(r) for k in keys}, ensure_ascii=r.random() < 0.5))
    good = {"kind": "báo CÁO", "year": 2001, "note": "n", "none": "x"}
    for _ in range(120):
        out.append(json.dumps({**good, **{k: value(r) for k in r.sample([*SCHEMA["properties"]], r.randrange(3))}}))
    return out


def plain(name, raw, change):
    t = metadata.Template.of(TEMPLATES[name])
    try:
        return change(t, json.loads(raw))
    except ValueError:
        return raw


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, n, x) for i, (n, x) in enumerate((n, x) for x in texts() for n in ("t", "u"))] + [(10**6, "none", "{}"), (10**6 + 1, "t", None), (10**6 + 2, None, "{}")]
    return data, spark.createDataFrame(data, "id long, template string, j string").repartition(8).cache()


def read(text):
    try:
        return json.loads(text)
    except ValueError:
        return text


CHANGES = {
    "normalize_enum": lambda t, node: t.normalised(node),
    "coerce_required": lambda t, node: t.coerced(node) if isinstance(node, dict) else node,
    "flatten_payload": lambda t, node: t.flat(node),
}


@pytest.mark.parametrize("name", sorted(CHANGES))
def test_rewriting(rows, name):
    data, df = rows
    got = {r["id"]: r["x"] for r in df.select("id", getattr(metadata, name)(F.col("template"), F.col("j"), TEMPLATES).alias("x")).collect()}
    for i, template, raw in data:
        if template not in TEMPLATES or raw is None:
            assert got[i] is None
        else:
            assert read(got[i]) == plain(template, raw, CHANGES[name]), (template, raw)


def test_validation(rows):
    data, df = rows
    got = {r["id"]: r["x"] for r in df.select("id", metadata.validate_metadata(F.col("template"), F.col("j"), TEMPLATES).alias("x")).collect()}
    valid = 0
    for i, template, raw in data:
        if template not in TEMPLATES or raw is None:
            assert got[i] is None
            continue
        want = plain(template, raw, lambda t, node: t.errors(node))
        want = ["not JSON"] if want == raw else want
        assert (got[i]["is_valid"], got[i]["errors"]) == (not want, "; ".join(want)), (template, raw)
        valid += not want
    assert valid > 30


def test_finishing(rows):
    data, df = rows
    out = df.select("id", metadata.finish_metadata(F.col("template"), F.col("j"), TEMPLATES).alias("x"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    got = {r["id"]: r["x"] for r in out.collect()}
    for i, template, raw in data:
        x = got[i]
        if template not in TEMPLATES or raw is None:
            assert (x["json"], x["is_valid"], x["extracted"], x["payload"]) == (None, False, False, None) and x["errors"] == ("no response" if template == "t" else "no template")
            continue
        t = metadata.Template.of(TEMPLATES[template])
        try:
            node = t.normalised(json.loads(raw))
            filled = t.coerced(node) if isinstance(node, dict) else node
            put = frozenset(k for k in filled if filled[k] == "other" and node[k] != "other") if isinstance(filled, dict) else frozenset()
            errors = t.errors(filled, put)
        except ValueError:
            filled, errors = None, ["not JSON"]
        final = t.defaults() if errors else filled
        assert (x["is_valid"], x["errors"], x["extracted"]) == (not errors, "; ".join(errors), final != t.defaults()), raw
        assert json.loads(x["json"]) == final and json.loads(x["payload"]) == t.flat(final), raw


def test_folding_equals_the_helper(spark):
    chars = [chr(c) for c in range(0x20, 0x3000) if not 0xD800 <= c < 0xE000] + list("ếỘđĐßİ가각ｶ")
    df = spark.createDataFrame([(c,) for c in chars] + [("Báo Cáo ĐƠN",)], "c string").select("c", metadata.fold(F.col("c")).alias("f"))
    wrong = [r["c"] for r in df.collect() if r["f"] != folded(r["c"])]
    assert len(wrong) < 60 and not set("".join(wrong)) & set("áàảãạăâđéèêíìóòôơúùưýÁÀĐÉÊÍÓÔƠÚƯÝ")


def test_a_key_twice_is_bad_json(spark):
    df = spark.createDataFrame([('{"b":1,"b":2}',)], "j string")
    assert df.select(metadata.validate_metadata(F.lit("u"), F.col("j"), TEMPLATES).alias("x")).first()["x"]["errors"] == "not JSON"

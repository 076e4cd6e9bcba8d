"""Typed metadata against a JSON Schema: a template is read once on the driver, its rules go to the rows."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from unicodedata import category, normalize

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfoundry.functions.text import folded

#: Defaults by format and by type.
FORMAT_DEFAULTS = {"date": "0001-01-01", "date-time": "0001-01-01T00:00:00", "time": "00:00:00"}
TYPE_DEFAULTS = {"integer": 0, "number": 0, "boolean": False, "array": []}
INDEX_TYPES = {"integer": "integer", "number": "float", "boolean": "bool", "datetime": "datetime"}
_SHAPES = {"date": r"\d{4}-\d{2}-\d{2}", "date-time": r"\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?([Zz]|[+-]\d{2}:\d{2})?", "time": r"\d{2}:\d{2}(:\d{2})?.*"}


def _branches(spec: dict) -> list[dict]:
    return [spec, *(b for b in spec.get("oneOf", []) if isinstance(b, dict))]


def _types(spec: dict) -> list[str]:
    t = spec.get("type")
    return [t] if isinstance(t, str) else list(t or [])


@dataclass
class Template:
    """What a schema says, by dotted path."""

    schema: dict
    types: dict[str, str] = field(default_factory=dict)
    enums: dict[str, dict[str, str]] = field(default_factory=dict)

    @classmethod
    def of(cls, text: str) -> Template:
        t = cls(json.loads(text))
        t._read(t.schema, "")
        return t

    def _read(self, spec: dict, prefix: str) -> None:
        for name, own in spec.get("properties", {}).items():
            key = f"{prefix}.{name}" if prefix else name
            if kind := self.kind(own):
                self.types[key] = kind
            for b in _branches(own):
                if values := [v for v in b.get("enum", []) if isinstance(v, str)]:
                    by_fold: dict[str, str] = {}
                    for v in values:
                        by_fold.setdefault(folded(v), v)
                    by_fold.pop("", None)
                    self.enums.setdefault(key, by_fold)
            self._read(own, key)

    @staticmethod
    def kind(spec: dict) -> str | None:
        for b in (*_branches(spec)[1:], spec):
            if "properties" in b:
                return "object"
            if "items" in b:
                return "array"
            if b.get("format") in ("date", "date-time"):
                return "datetime"
            if real := [t for t in _types(b) if t != "null"]:
                return real[0]
        return None

    def default(self, spec: dict):
        if any("enum" in b for b in _branches(spec)):
            return "other"
        if (form := str(spec.get("format", "")).lower()) in FORMAT_DEFAULTS:
            return FORMAT_DEFAULTS[form]
        return TYPE_DEFAULTS.get(next((t for b in (*_branches(spec)[1:], spec) for t in _types(b) if t != "null"), ""), "")

    def defaults(self) -> dict:
        return {k: self.default(v) for k, v in self.schema.get("properties", {}).items()}

    def index_type(self, key: str) -> str:
        return INDEX_TYPES.get(self.types.get(key, ""), "keyword")

    def normalised(self, node, prefix: str = ""):
        """node with texts that equal an enum value but for case and marks replaced by it; lists keep their path."""
        if isinstance(node, list):
            return [self.normalised(x, prefix) if isinstance(x, (dict, list)) else x for x in node]
        if not isinstance(node, dict):
            return node
        out = {}
        for k, v in node.items():
            key = f"{prefix}.{k}" if prefix else k
            out[k] = self.enums.get(key, {}).get(folded(v), v) if isinstance(v, str) else self.normalised(v, key)
        return out

    def coerced(self, node: dict) -> dict:
        """node with required fields that are there but null or empty set to their defaults."""
        required, specs = set(self.schema.get("required", [])), self.schema.get("properties", {})
        return {k: self.default(specs[k]) if k in required and k in specs and v in (None, "") else v for k, v in node.items()}

    def errors(self, node, patched: frozenset[str] = frozenset(), schema: dict | None = None) -> list[str]:
        """What is wrong with a node, objects within it included, under their dotted paths."""
        if not isinstance(node, dict):
            return ["not an object"]
        schema = self.schema if schema is None else schema
        specs = schema.get("properties", {})
        out = [f"{k}: required" for k in schema.get("required", []) if k not in node]
        if schema.get("additionalProperties") is False:
            out += [f"{k}: unknown" for k in node if k not in specs]
        for k, spec in specs.items():
            if k in node and not any(self._fits(node[k], b, k in patched) for b in (spec.get("oneOf") or [spec])):
                out.append(f"{k}: invalid")
            elif isinstance(node.get(k), dict) and "properties" in spec:
                out += [f"{k}.{e}" for e in self.errors(node[k], schema=spec)]
        return out

    @staticmethod
    def _fits(v, spec: dict, other: bool) -> bool:
        checks = {"string": lambda: isinstance(v, str), "boolean": lambda: isinstance(v, bool), "array": lambda: isinstance(v, list), "object": lambda: isinstance(v, dict), "null": lambda: v is None}
        checks |= {"integer": lambda: isinstance(v, int) and not isinstance(v, bool) or isinstance(v, float) and v.is_integer(), "number": lambda: isinstance(v, (int, float)) and not isinstance(v, bool)}
        if (types := _types(spec)) and not any(checks.get(t, lambda: True)() for t in types):
            return False
        if "enum" in spec and v not in spec["enum"] and not (other and v == "other"):
            return False
        if isinstance(v, str):
            form = _SHAPES.get(spec.get("format", ""))
            return (form is None or re.fullmatch(form, v) is not None) and spec.get("minLength", 0) <= len(v) <= spec.get("maxLength", 1 << 60)
        return True

    def flat(self, node, prefix: str = "") -> dict:
        """Payload by dotted path: nulls and empty lists left out, texts turned into what the schema says where they parse."""
        if isinstance(node, dict):
            out = {}
            for k, v in node.items():
                out |= self.flat(v, f"{prefix}.{k}" if prefix else k)
            return out
        if isinstance(node, list):
            kept = [v for v in node if isinstance(v, (str, int, float, bool))]
            return {prefix: kept} if kept else {}
        if node is None:
            return {}
        return {prefix: self._typed(node, self.types.get(prefix)) if isinstance(node, str) else node}

    @staticmethod
    def _typed(text: str, kind: str | None):
        try:
            if kind == "integer":
                return int(text)
            if kind == "number":
                return float(text)
        except ValueError:
            return text
        return text.strip().lower() == "true" if kind == "boolean" and text.strip().lower() in ("true", "false") else text


def template_rules(templates: DataFrame) -> DataFrame:
    """(template_id, key, index_type, default_value as JSON) of each top-level property of schemas (template_id, json_schema).

    A schema's own properties are read as rows; of alternatives (oneOf) the first that isn't null tells the type.
    """
    branch = "type:string,format:string,enum:string,items:string,properties:string"
    kind = f"struct<properties:map<string,struct<{branch},oneOf:array<struct<{branch}>>>>>"
    rows = templates.select("template_id", F.explode(F.from_json("json_schema", kind)["properties"]).alias("key", "spec"))
    spec = F.col("spec")
    own = F.array(F.struct(*(spec[c].alias(c) for c in ("type", "format", "enum", "items", "properties"))))
    every = F.concat(F.coalesce(spec["oneOf"], F.array().cast(f"array<struct<{branch}>>")), own)
    named = lambda b: F.filter(F.regexp_extract_all(F.coalesce(b["type"], F.lit("")), F.lit("[a-z]+"), F.lit(0)), lambda t: t != "null")
    types = F.flatten(F.transform(every, named))
    shape = lambda b: F.when(b["properties"].isNotNull(), "object").when(b["items"].isNotNull(), "array").when(b["format"].isin("date", "date-time"), "datetime").otherwise(F.get(named(b), F.lit(0)))
    indexed = F.get(F.filter(F.transform(every, shape), lambda x: x.isNotNull()), F.lit(0))
    pick = lambda table, value, other: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), value), other)
    as_json = {k: json.dumps(v) for k, v in TYPE_DEFAULTS.items()}
    form = pick({k: json.dumps(v) for k, v in FORMAT_DEFAULTS.items()}, F.lower(spec["format"]), pick(as_json, F.get(types, F.lit(0)), F.lit('""')))
    default = F.when(F.exists(every, lambda b: b["enum"].isNotNull()), F.lit('"other"')).otherwise(form)
    return rows.select("template_id", "key", pick(INDEX_TYPES, indexed, F.lit("keyword")).alias("index_type"), default.alias("default_value"))


# --- values as VARIANT: rules of a template, a bounded set on the driver, become conditions on columns -----------------------------

_NUMBERS = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")
_DEPTH = 6  # levels of objects that flatten_payload() takes apart, and of lists that normalize_enum() looks into
_MAP, _LIST = "map<string,variant>", "array<variant>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _kind(x: Column) -> Column:
    """STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN, VOID (JSON's null), OBJECT or ARRAY; null where there is no value."""
    return F.regexp_extract(F.schema_of_variant(x), "^[A-Z]+", 0)


def _as(x: Column, kind: str) -> Column:
    return F.try_variant_get(x, "$", kind)


def _json(value) -> Column:
    return F.parse_json(F.lit(json.dumps(value)))


def _pick(table: dict[str, str], key: Column) -> Column:
    """The entry of a small table; null without one."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key) if table else F.lit(None).cast("string")


def _letters() -> tuple[str, str]:
    """Letters that are one letter with marks when they are taken apart, and those letters: a rule of Unicode, as a table for translate()."""
    pairs = []
    for c in map(chr, range(0xC0, 0x2FA1E)):
        bare = "".join(x for x in normalize("NFD", c) if category(x) != "Mn")
        if len(bare) == 1 and bare != c:
            pairs.append((c, bare))
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _BARE = _letters()


def fold(text: Column) -> Column:
    """Text without marks and in lower case, by built-in functions; equal to fold_text() on composed text."""
    return F.lower(F.regexp_replace(F.translate(text, _MARKED, _BARE), r"\p{Mn}", ""))


def _is(x: Column, kind: str) -> Column:
    k = _kind(x)
    if kind == "integer":
        return k.isin("BIGINT", "INT", "SMALLINT", "TINYINT") | k.isin(*_NUMBERS) & F.coalesce(_as(x, "double") % 1 == 0, F.lit(False))
    return {"string": k == "STRING", "boolean": k == "BOOLEAN", "array": k == "ARRAY", "object": k == "OBJECT", "null": k == "VOID", "number": k.isin(*_NUMBERS)}.get(kind, F.lit(True))


def _fits(x: Column, spec: dict, other: Column) -> Column:
    """Whether a value meets one branch of a property; `other`: whether the text "other" may stand for an enum value."""
    out, string = F.lit(True), _kind(x) == "STRING"
    if types := _types(spec):
        any_type = F.lit(False)
        for t in types:
            any_type = any_type | _is(x, t)
        out = out & any_type
    if "enum" in spec:
        texts = [v for v in spec["enum"] if isinstance(v, str)]
        numbers = [float(v) for v in spec["enum"] if isinstance(v, (int, float)) and not isinstance(v, bool)]
        rest = [json.dumps(v, separators=(",", ":"), ensure_ascii=False) for v in spec["enum"] if v is None or isinstance(v, (bool, list, dict))]
        listed = string & _as(x, "string").isin(texts) | string & other & (_as(x, "string") == "other")
        if numbers:
            listed = listed | _kind(x).isin(*_NUMBERS) & _as(x, "double").isin(numbers)
        out = out & (listed | ~string & F.to_json(x).isin(rest) if rest else listed)
    text, least, most = _as(x, "string"), spec.get("minLength", 0), spec.get("maxLength", 1 << 60)
    shape = _SHAPES.get(spec.get("format", ""))
    if shape or least or "maxLength" in spec:
        well = F.char_length(text).between(least, most)
        if shape:
            well = well & text.rlike(rf"\A(?:{shape})\z")
        out = out & (~string | well)
    return F.coalesce(out, F.lit(False))


def _errors(x: Column, text: Column, schema: dict, patched: Callable[[str], Column] = lambda k: F.lit(False)) -> Column:
    """What is wrong with a value, in order: required keys that lack, unknown keys as they come in the text, then by property."""
    specs, required = schema.get("properties", {}), schema.get("required", [])
    none = F.array().cast("array<string>")

    def of(own: Column) -> Column:
        there = lambda k: F.coalesce(F.map_contains_key(own, F.lit(k)), F.lit(False))
        parts = [F.array(*(F.when(~there(k), F.lit(f"{k}: required")) for k in required)) if required else none]
        if schema.get("additionalProperties") is False:
            keys = F.coalesce(F.array_distinct(F.json_object_keys(text)), none)
            strange = F.filter(keys, lambda k: ~k.isin(list(specs))) if specs else keys
            parts.append(F.transform(strange, lambda k: F.concat(k, F.lit(": unknown"))))
        for k, spec in specs.items():
            value = F.try_element_at(own, F.lit(k))
            fits = F.lit(False)
            for b in spec.get("oneOf") or [spec]:
                fits = fits | _fits(value, b, patched(k))
            found = F.when(there(k) & ~fits, F.array(F.lit(f"{k}: invalid")))
            if "properties" in spec:
                inner = _errors(value, F.get_json_object(text, f"$['{k}']"), spec)
                found = found.when(_kind(value) == "OBJECT", F.transform(inner, lambda e: F.concat(F.lit(f"{k}."), e)))  # noqa: B023
            parts.append(found.otherwise(none))
        return F.array_compact(F.concat(*parts))

    return F.when(_kind(x) == "OBJECT", _let(_as(x, _MAP), of)).otherwise(F.array(F.lit("not an object")))


def _normalised(x: Column, t: Template, spec: dict, prefix: str = "", depth: int = _DEPTH) -> Column:
    """x with texts that equal an enum value but for case and marks replaced by it; what has no enum below it stays as it is."""
    below = {}
    for name, own in spec.get("properties", {}).items():
        key = f"{prefix}.{name}" if prefix else name
        if any(k == key or k.startswith(f"{key}.") for k in t.enums):
            below[name] = (key, own)
    if not below or not depth:
        return x

    def one(name: str, v: Column) -> Column:
        key, own = below[name]
        text = F.coalesce(_pick(t.enums.get(key, {}), fold(_as(v, "string"))), _as(v, "string")).cast("variant")
        return F.when(_kind(v) == "STRING", text).otherwise(_normalised(v, t, own, key, depth - 1))

    def inside(k: Column, v: Column) -> Column:
        out = F.when(F.lit(False), v)
        for name in below:
            out = out.when(k == name, one(name, v))
        return out.otherwise(v)

    changed = F.to_variant_object(F.transform_values(_as(x, _MAP), inside))
    items = F.to_variant_object(F.transform(_as(x, _LIST), lambda v: F.when(_kind(v) == "STRING", v).otherwise(_normalised(v, t, spec, prefix, depth - 1))))
    return F.when(_kind(x) == "OBJECT", changed).when(_kind(x) == "ARRAY", items).otherwise(x)


def _coerced(x: Column, t: Template) -> Column:
    """x with required fields that are there but null or empty set to their defaults."""
    required, specs = set(t.schema.get("required", [])), t.schema.get("properties", {})
    filled = {k: _json(t.default(specs[k])) for k in specs if k in required}
    if not filled:
        return x

    def inside(k: Column, v: Column) -> Column:
        blank = (_kind(v) == "VOID") | (_kind(v) == "STRING") & (_as(v, "string") == "")
        out = F.when(F.lit(False), v)
        for name, default in filled.items():
            out = out.when((k == name) & blank, default)
        return out.otherwise(v)

    return F.when(_kind(x) == "OBJECT", F.to_variant_object(F.transform_values(_as(x, _MAP), inside))).otherwise(x)


def _entries(x: Column, path: Column, t: Template, depth: int = _DEPTH) -> Column:
    """[(key, value)] of the payload of x: nulls and empty lists left out, texts turned into what the schema says where they parse."""
    pair = lambda value: F.array(F.struct(path.alias("key"), value.alias("value")))
    none = F.array().cast("array<struct<key:string,value:variant>>")
    k, text = _kind(x), _as(x, "string")
    kind = F.coalesce(_pick(t.types, path), F.lit(""))
    word = F.lower(F.trim(text))
    typed = (
        F.when((kind == "integer") & text.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(text).try_cast("bigint").cast("variant"))
        .when((kind == "number") & text.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), F.trim(text).try_cast("double").cast("variant"))
        .when((kind == "boolean") & word.isin("true", "false"), (word == "true").cast("variant"))
    )
    scalars = F.filter(_as(x, _LIST), lambda v: _kind(v).isin("STRING", "BOOLEAN", *_NUMBERS))
    out = F.when(k == "VOID", none).when(k == "STRING", pair(F.coalesce(typed, x))).when(k == "ARRAY", F.when(F.size(scalars) > 0, pair(F.to_variant_object(scalars))).otherwise(none))
    if depth:
        inner = lambda e: _entries(e["value"], F.when(path == "", e["key"]).otherwise(F.concat(path, F.lit("."), e["key"])), t, depth - 1)
        out = out.when(k == "OBJECT", F.flatten(F.transform(F.map_entries(_as(x, _MAP)), inner)))
    return out.otherwise(pair(x))


def _payload(x: Column, t: Template) -> Column:
    """The payload of x as JSON; of keys that come twice by their dots the last counts."""
    last = lambda es: F.filter(es, lambda e, i: ~F.exists(F.slice(es, i + 2, F.size(es)), lambda later: later["key"] == e["key"]))
    return _let(_entries(x, F.lit(""), t), lambda es: F.to_json(F.map_from_entries(last(es))))


def _of_template(template: Column, templates: dict[str, str], of: Callable[[Template], Column], unknown: Column) -> Column:
    """What `of` makes of each template, for rows of that template."""
    out = F.when(F.lit(False), unknown)
    for name, text in templates.items():
        out = out.when(template == name, of(Template.of(text)))
    return out.otherwise(unknown)


def _rewritten(template: Column, text: Column, templates: dict[str, str], change: Callable[[Column, Template], Column]) -> Column:
    def of(t: Template) -> Column:
        return _let(F.try_parse_json(text), lambda v: F.when(v.isNull(), text).otherwise(change(v, t)))

    return _of_template(template, templates, of, F.lit(None).cast("string"))


def normalize_enum(template: Column, text: Column, templates: dict[str, str]) -> Column:
    """The JSON text with texts that equal an enum value but for case and marks replaced by it; bad JSON as it is.

    Here and below: built-in functions only; null for an unknown template or a null text; a text with a key twice in one object is bad
    JSON. templates: schema text by name, a bounded set, whose rules become part of the plan.
    """
    return _rewritten(template, text, templates, lambda v, t: F.to_json(_normalised(v, t, t.schema)))


def coerce_required(template: Column, text: Column, templates: dict[str, str]) -> Column:
    """The JSON text with required fields that are there but null or empty set to their defaults; bad JSON as it is."""
    return _rewritten(template, text, templates, lambda v, t: F.to_json(_coerced(v, t)))


def flatten_payload(template: Column, text: Column, templates: dict[str, str]) -> Column:
    """The payload by dotted path, as JSON; bad JSON as it is. Objects below the sixth level stay whole."""
    return _rewritten(template, text, templates, _payload)


def validate_metadata(template: Column, text: Column, templates: dict[str, str]) -> Column:
    """A struct (is_valid, errors) of a JSON text against its template's schema."""
    unknown = F.lit(None).cast("struct<is_valid:boolean,errors:string>")

    def of(t: Template) -> Column:
        found = _let(F.try_parse_json(text), lambda v: F.when(v.isNull(), F.array(F.lit("not JSON"))).otherwise(_errors(v, text, t.schema)))
        return _let(found, lambda e: F.when(text.isNotNull(), F.struct((F.size(e) == 0).alias("is_valid"), F.array_join(e, "; ").alias("errors"))))

    return _of_template(template, templates, of, unknown)


def finish_metadata(template: Column, text: Column, templates: dict[str, str]) -> Column:
    """A struct for each response: json (checked metadata, or the template's defaults), is_valid, extracted, errors, payload (JSON).

    Enum values are normalised, required blanks filled, the rest checked; what isn't valid gives way to the defaults. A row of another
    template, or null text, is not extracted and has null json.
    """

    def row(j: Column, valid: Column, extracted: Column, errors: Column, payload: Column) -> Column:
        return F.struct(j.alias("json"), valid.alias("is_valid"), extracted.alias("extracted"), errors.alias("errors"), payload.alias("payload"))

    no, null = F.lit(False), F.lit(None).cast("string")

    def of(t: Template) -> Column:
        defaults = json.dumps(t.defaults())

        def checked(node: Column) -> Column:
            def filled(x: Column) -> Column:
                said = lambda v, k: F.coalesce(_as(F.try_element_at(_as(v, _MAP), F.lit(k)), "string"), F.lit(""))
                put = lambda k: (said(x, k) == "other") & (said(node, k) != "other")
                errors = F.when(x.isNull(), F.array(F.lit("not JSON"))).otherwise(_errors(x, text, t.schema, put))

                def ended(e: Column) -> Column:
                    plain = F.parse_json(F.lit(defaults))
                    final = lambda f: row(F.to_json(f), F.size(e) == 0, F.to_json(f) != F.to_json(plain), F.array_join(e, "; "), _payload(f, t))
                    return _let(F.when(F.size(e) > 0, plain).otherwise(x), final)

                return _let(errors, ended)

            return _let(_coerced(node, t), filled)

        made = _let(F.try_parse_json(text), lambda v: _let(_normalised(v, t, t.schema), checked))
        return F.when(text.isNull(), row(null, no, no, F.lit("no response"), null)).otherwise(made)

    return _of_template(template, templates, of, row(null, no, no, F.lit("no template"), null))

"""Texts of pages, object keys, model responses."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The footer of a page, characters that object keys can't have, and what stands between the words of an answer.
_FOOTER = r"(?:\r?\n|\r)Page\s+\d+(?:\r?\n|\r){2}-{3}(?:\r?\n|\r)"
_UNSAFE = r"[\\{}^%`\]\[\"<>#|?$&]"
_SEPARATORS = r"[\s,;:.!?()\[\]'\"]+"
_END = "<|return|>"


def split_pages(text: Column) -> Column:
    """The trimmed pages between page footers, without blank ones; the whole text if nothing is left, none of an empty one."""
    pages = F.filter(F.transform(F.split(text, _FOOTER), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).when(F.size(pages) > 0, pages).otherwise(F.array(text))


def first_pages(text: Column, n: int = 10) -> Column:
    return F.array_join(F.slice(split_pages(text), 1, n), "\n\n---\n\n")


@F.arrow_udf(StringType())
def nfc(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else t if t.isascii() else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def fold_text(texts: pa.Array) -> pa.Array:
    """Lower case without combining marks; letters that don't decompose, such as đ, stay."""
    return pa.array([None if t is None else folded(t) for t in texts.to_pylist()], pa.string())


def folded(t: str) -> str:
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn")).lower()


def normalize_object_key(name: Column, fallback: Column) -> Column:
    """A key that object stores take: path kept, blanks and unsafe characters to single hyphens, lower case, 255 characters at most.

    `fallback` stands in where nothing is left of the name.
    """
    whole = nfc(name)
    path = F.regexp_extract(whole, r"(?s)^(.*/)?", 0)
    file = F.trim(F.regexp_extract(whole, r"(?s)([^/]*)$", 1))
    ext = F.regexp_extract(file, r"(?s)(\.[^.]+)$", 1)
    stem = F.when(ext != "", F.substr(file, F.lit(1), F.length(file) - F.length(ext))).otherwise(F.regexp_replace(file, r"\.$", ""))
    clean = F.regexp_replace(F.regexp_replace(stem, r"\p{Cc}", ""), r"[\s\p{Z}]+", "-")
    clean = F.regexp_replace(F.regexp_replace(clean, _UNSAFE, "-"), "-{2,}", "-")
    clean = F.regexp_replace(F.lower(clean), "^-+|-+$", "")
    made = F.substring(F.concat(F.when(F.trim(clean) == "", fallback).otherwise(clean), F.lower(ext)), 1, 255)
    return F.when(F.coalesce(F.trim(name), F.lit("")) == "", fallback).otherwise(F.concat(path, made))


def rewrite_image_links(markdown: Column, keys: Column, prefix: Column) -> Column:
    """Markdown and HTML image links to each of the keys, with `prefix` before the key."""
    quoted = lambda k: F.concat(F.lit(r"\Q"), k, F.lit(r"\E"))

    def one(text: Column, key: Column) -> Column:
        url = F.regexp_replace(F.concat(prefix, key), r"([\\$])", r"\\$1")
        text = F.regexp_replace(text, F.concat(F.lit(r"!\[([^\]]*)\]\("), quoted(key), F.lit(r"\)")), F.concat(F.lit("![$1]("), url, F.lit(")")))
        return F.regexp_replace(text, F.concat(F.lit(r"(?i)(<img\b[^>]*?)\bsrc=\""), quoted(key), F.lit("\"([^>]*?>)")), F.concat(F.lit('$1src="'), url, F.lit('"$2')))

    return F.aggregate(F.array_sort(keys), markdown, one)


WORD = r"\p{L}\p{Mn}\p{Nd}\p{Pc}"  #: characters of words in any script
ASCII_WORD = "0-9A-Za-z_"


def _whole(word: str, of: str) -> str:
    """A pattern of a whole word, said by its characters, since what \\b stands for differs between engines and versions of Java."""
    edge = f"(?:(?<=[{of}])(?![{of}])|(?<![{of}])(?=[{of}]))"
    return f"{edge}{re.escape(word)}{edge}"


def extract_choice(text: Column, choices: list[str], word: str = WORD) -> Column:
    """The choice that a response names: all of it, else the whole word furthest right, else the last token that is one; else null.

    word: the characters that words are made of, as in a regular expression's brackets."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    exact = F.coalesce(*(F.when(F.lower(trimmed) == c.lower(), c) for c in choices))
    # the text up to the last whole word that is this choice tells where it stands
    place = [F.length(F.regexp_extract(text, f"(?is)^(.*){_whole(c, word)}", 1)) + F.when(text.rlike(f"(?i){_whole(c, word)}"), 1).otherwise(-1) for c in choices]
    ranked = F.array_max(F.array(*(F.when(p > 0, F.struct(p.alias("at"), F.lit(-i).alias("i"), F.lit(c).alias("c"))) for i, (p, c) in enumerate(zip(place, choices)))))
    parts = F.reverse(F.filter(F.split(trimmed, _SEPARATORS), lambda x: x != ""))
    known = F.filter(parts, lambda x: F.lower(x).isin(*(c.lower() for c in choices)))
    token = F.coalesce(*(F.when(F.lower(F.get(known, F.lit(0))) == c.lower(), c) for c in choices))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.lit(None).cast("string")).otherwise(F.coalesce(exact, ranked["c"], token))


def clean_response(text: Column, thinking: bool = False, end: str = _END) -> Column:
    """Without the end mark, trimmed; of a thinking model, without opening think tags in any case. Null is empty."""
    kept = F.regexp_replace(text, "(?i)<think>", "") if thinking else text
    return F.coalesce(F.regexp_replace(F.replace(kept, F.lit(end), F.lit("")), r"^\s+|\s+$", ""), F.lit(""))


_ESCAPE = re.compile(r'\\(?:[\\"/bfnrt]|u[0-9a-fA-F]{4})|\\')
_QUOTED = re.compile(r'"(?:[^"\\]|\\.)*"?', re.DOTALL)
_FENCED = re.compile(r"```[A-Za-z]*\s*\n(.*?)```", re.DOTALL)


def repaired(text: str) -> str:
    """Lone backslashes doubled and line breaks inside of strings escaped, so that JSON parses."""
    doubled = _ESCAPE.sub(lambda m: m.group() if len(m.group()) > 1 else "\\\\", text)
    return _QUOTED.sub(lambda m: re.sub(r"\r\n|\r|\n", r"\\n", m.group()), doubled)


@F.arrow_udf(StringType())
def repair_json(texts: pa.Array) -> pa.Array:
    """The text as JSON that parses: as it is, repaired, or the repaired body of its first fence; null if none does."""
    import json

    def first(t: str | None) -> str | None:
        fence = _FENCED.search(t or "")
        for candidate in (t, repaired(t or ""), repaired(fence[1]) if fence else None):
            try:
                json.loads(candidate or "")
                return candidate
            except ValueError:
                continue
        return None

    return pa.array([first(t) for t in texts.to_pylist()], pa.string())


def parse_departments(claim: Column) -> Column:
    """(id, primary, role) of a claim's JSON list; an empty list where it doesn't parse."""
    kind = "array<struct<Id:string,IsPrimary:boolean,Role:string>>"
    return F.coalesce(F.transform(F.from_json(claim, kind), lambda d: F.struct(d["Id"].alias("id"), F.coalesce(d["IsPrimary"], F.lit(False)).alias("is_primary"), d["Role"].alias("role"))), F.array().cast("array<struct<id:string,is_primary:boolean,role:string>>"))

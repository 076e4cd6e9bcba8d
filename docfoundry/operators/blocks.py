"""Texts cut into runs of lines, an Arrow batch of texts at a time: blocks of one kind, and sections from heading to heading.

The rules are those of lines.classify_lines(), for callers who need no row for each line: no line is sorted or shuffled, and a run's
text is a slice of the batch.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lines import dealt

KINDS = ["code", "blank", "html", "table", "heading", "rule", "list", "quote", "indented", "paragraph"]
_CODE, _BLANK, _HTML, _TABLE, _HEADING, _RULE, _LIST, _QUOTE, _INDENTED, _PARAGRAPH = range(len(KINDS))
_TRIVIAL = (_HEADING, _HTML, _RULE, _BLANK)
DEPTH = 5

BLOCKS = "array<struct<start:bigint,end:bigint,n_lines:int,kind:string,title:string,text:string>>"
SECTIONS = "array<struct<n:int,level:int,head:string,start:bigint,size:bigint,trivial:boolean,blank:boolean,content:string>>"

# Java's $ is also before a last line separator
_END = r"[\r\x{85}\x{2028}\x{2029}]?$"
_SEEN = r"[^ \t\n\x0B\f\r]"
_TAG = r"^ {0,3}<[A-Za-z/!?]"
_DELIMITER = r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*" + _END
_UNDERLINE = r"^ {0,3}(?:=+|-+)[ \t\r]*$"
_HEAD = r"^ {0,3}(?P<marks>#{1,6})(?:[ \t]|" + _END + ")"
_OTHERS = {
    _RULE: r"^ {0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})" + _END,
    _LIST: r"^ {0,3}(?:[-*+]|[0-9]{1,9}[.)])(?:[ \t]|" + _END + ")",
    _QUOTE: r"^ {0,3}>",
    _INDENTED: r"^(?: {4}| {0,3}\t)",
}
_FENCE = r"(?m)^ {0,3}(?:```|~~~)"
_FENCED = re.compile(r"^ {0,3}(?:(`{3,})[^`\n]*|(~{3,})[^\n]*)$(?s:.*?)(?:^ {0,3}(?:\1`*|\2~*)[ \t\r]*$|\Z)", re.MULTILINE)


def _has(strings: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(strings, pattern).to_numpy(zero_copy_only=False)


class _Lines:
    """The lines of a batch of texts: kind and level of each, where they start, in characters of their text and in bytes of the batch."""

    def __init__(self, texts: pa.Array):
        self.texts = texts
        split = pc.split_pattern(texts, "\n")
        self.lines, count = split.flatten(), pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        self.i = np.arange(len(self.lines))
        self.firsts = np.cumsum(count) - count
        self.first, self.last = np.repeat(self.firsts, count), np.repeat(self.firsts + count - 1, count)
        # characters of a line with its newline
        self.width = pc.utf8_length(self.lines).to_numpy().astype(np.int64) + (self.i != self.last)
        before = np.cumsum(self.width) - self.width
        self.start = before - before[self.first]
        self._classify()

    def latest(self, mask: np.ndarray) -> np.ndarray:
        """The last line of the text so far for which mask holds, or -1."""
        at = np.maximum.accumulate(np.where(mask, self.i, -1))
        return np.where(at >= self.first, at, -1)

    def _lag(self, mask: np.ndarray) -> np.ndarray:
        return np.r_[False, mask[:-1]] & (self.i != self.first)

    def _lead(self, mask: np.ndarray) -> np.ndarray:
        return np.r_[mask[1:], False] & (self.i != self.last)

    def _fenced(self) -> np.ndarray:
        code = np.zeros(len(self.i), bool)
        for d in np.flatnonzero(_has(self.texts, _FENCE)):
            text, at = self.texts[int(d)].as_py(), self.firsts[d]
            for m in _FENCED.finditer(text):
                code[at + text.count("\n", 0, m.start()) : at + text.count("\n", 0, m.end()) + 1] = True
        return code

    def _classify(self) -> None:
        lines, code = self.lines, self._fenced()
        blank = ~code & ~_has(lines, _SEEN)
        tag = ~code & _has(lines, _TAG)
        html = ~code & ~blank & (self.latest(tag) > self.latest(blank)) if tag.any() else tag
        bar = ~code & ~html & pc.match_substring(lines, "|").to_numpy(zero_copy_only=False)
        dashes = np.zeros(len(self.i), bool)
        dashes[bar] = _has(lines.filter(pa.array(bar)), _DELIMITER)
        opened = self.latest(bar & ~self._lag(bar))
        table = bar & self._lead(dashes)[opened]
        kind = np.select([code, blank, html, table], [_CODE, _BLANK, _HTML, _TABLE], _PARAGRAPH)
        marks = np.zeros(len(self.i), np.int32)
        rest = np.flatnonzero(kind == _PARAGRAPH)
        head = pc.struct_field(pc.extract_regex(lines.take(rest), _HEAD), "marks")
        marks[rest] = pc.fill_null(pc.utf8_length(head), 0).to_numpy(zero_copy_only=False)
        kind[marks > 0] = _HEADING
        for k, pattern in _OTHERS.items():
            rest = np.flatnonzero(kind == _PARAGRAPH)
            kind[rest[_has(lines.take(rest), pattern)]] = k
        self._titles(kind, marks)

    def _titles(self, kind: np.ndarray, marks: np.ndarray) -> None:
        lines, under = self.lines, _has(self.lines, _UNDERLINE)
        title = (kind == _PARAGRAPH) & self._lead(under) & ~under
        flush = kind != _INDENTED
        if not flush.all():
            above, text = (self.latest(m) for m in (flush, flush & (kind != _BLANK)))
            of = lambda at: np.where(at >= 0, kind[at], _CODE)
            lazy = np.isin(of(above), (_PARAGRAPH, _QUOTE))
            kind = np.where(flush, kind, np.where((text >= 0) & (of(text) == _LIST), _LIST, np.where(lazy, of(above), _CODE)))
        double = self._lead(pc.match_substring(lines, "=").to_numpy(zero_copy_only=False))
        self.title = title
        self.level = np.where(title, np.where(double, 1, 2), marks).astype(np.int32)
        self.kind = np.where(title | self._lag(title), _HEADING, kind)

    def listed(self, opens: np.ndarray, fields: dict) -> pa.Array:
        """For each text the list of its runs, as structs; opens marks their first lines."""
        each = np.add.reduceat(opens.astype(np.int32), self.firsts)
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(each)].astype(np.int32)), pa.StructArray.from_arrays(list(fields.values()), list(fields)))

    def slices(self, at: np.ndarray) -> pa.Array:
        """The texts from these lines to the next of them or the end of the text, newlines included."""
        _, offsets, data = self.texts.buffers()
        begin = int(np.frombuffer(offsets, np.int32, 1, 4 * self.texts.offset)[0])
        size = pc.binary_length(self.lines).to_numpy().astype(np.int64) + (self.i != self.last)
        ends = begin + np.cumsum(size)
        places = np.r_[(ends - size)[at], ends[-1]].astype(np.int32)
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(places), data if data is not None else pa.py_buffer(b""))


def _blocks(texts: pa.Array) -> pa.Array:
    x = _Lines(texts)
    opens = (x.i == x.first) | (x.kind != np.r_[-1, x.kind[:-1]])
    at = np.flatnonzero(opens)
    to = np.r_[at[1:], len(x.i)] - 1
    kind = x.kind[at]
    heading = x.latest(np.isin(x.kind, (_HEADING, _QUOTE)))
    # the line that is a table's title: the last of a heading or quote before
    before = np.where(at > x.first[at], heading[at - 1], -1)
    wanted = np.isin(kind, (_TABLE, _HTML))
    title = pc.utf8_trim(x.lines.take(pa.array(before, mask=~wanted | (before < 0))), " ")
    title = pc.if_else(pa.array(wanted), pc.fill_null(title, ""), pa.scalar(None, pa.string()))
    groups = pa.ListArray.from_arrays(pa.array(np.r_[at, len(x.i)].astype(np.int32)), x.lines)
    size = np.add.reduceat(x.width, at) - (to != x.last[at])
    return x.listed(opens, {
        "start": pa.array(x.start[at]),
        "end": pa.array(x.start[at] + size - 1),
        "n_lines": pa.array((to - at + 1).astype(np.int32)),
        "kind": pa.array(KINDS).take(pa.array(kind)),
        "title": title,
        "text": pc.binary_join(groups, "\n"),
    })


def _sections(texts: pa.Array) -> pa.Array:
    x = _Lines(texts)
    cuts = (x.level >= 1) & (x.level <= DEPTH)
    opens = cuts | (x.i == x.first)
    at = np.flatnonzero(opens)
    head, below = x.lines.take(pa.array(at, mask=~cuts[at])), x.lines.take(pa.array(at + 1, mask=~x.title[at]))
    head = pc.coalesce(pc.binary_join_element_wise(head, below, "\n"), head)
    return x.listed(opens, {
        "n": pa.array((at - x.first[at] + 1).astype(np.int32)),
        "level": pa.array(np.where(cuts, x.level, 0)[at].astype(np.int32)),
        "head": head,
        "start": pa.array(x.start[at]),
        "size": pa.array(np.add.reduceat(x.width, at)),
        "trivial": pa.array(np.logical_and.reduceat(np.isin(x.kind, _TRIVIAL), at)),
        "blank": pa.array(np.logical_and.reduceat(x.kind == _BLANK, at)),
        "content": x.slices(at),
    })


def _by_batch(make, kind: str):
    def run(texts: pa.Array) -> pa.Array:
        whole = pc.fill_null(texts, "")
        # what a batch needs besides its texts grows with their lines, so large batches go in parts
        made = [make(whole.slice(i, 1000)) for i in range(0, len(whole), 1000)]
        return pa.concat_arrays(made) if made else pa.nulls(0)

    # not deterministic in name only: filters on its result would otherwise run it again below themselves
    return F.arrow_udf(run, kind).asNondeterministic()


def _each(docs: DataFrame, make, kind: str, name: str) -> DataFrame:
    texts = dealt(docs.filter("text is not null").select("doc_id", "text"))
    return texts.select("doc_id", _by_batch(make, kind)("text").alias(name))


def block_lists(docs: DataFrame) -> DataFrame:
    """(doc_id, b): for each text the list of its runs of lines of one kind; end is the place of the last character, title the last line
    of the heading or quote before a table or HTML, empty without. Null texts have no row."""
    return _each(docs, _blocks, BLOCKS, "b")


def section_lists(docs: DataFrame) -> DataFrame:
    """(doc_id, s): for each text the list of its runs of lines from one heading of level 1 to 5 to the next; n is the run's first line,
    level 0 if it has no heading, content ends with its newline. Null texts have no row."""
    return _each(docs, _sections, SECTIONS, "s")

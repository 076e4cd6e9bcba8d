"""Licence scans: fixed phrases, and templates found by an exact set-similarity join.

A text block meets a template if it holds `threshold` of the template's distinct words. Blocks are the lines, and within each
paragraph of several lines, for each template, windows of twice its length with a stride of its length, so that a notice wrapped
over lines lies in one of them whole. Only words of some template can be shared; they are ordered by the number of texts in the
whole corpus that hold them, rarest first, and a block is the sorted array of the places in that order of its m such words. A block
that meets a template of n words with least overlap o holds one of the template's first n - o + 1 (prefix filter), has o such words
itself (length filter), and its first match, at place i of the template and place j of its own array, leaves min(n - i, m - j) of
at least o words to share (positional filter). What passes is counted exactly. The templates are few and known, so they are joined
as literals, without a shuffle. Built-in functions only.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Base phrases and their labels.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

# Notices that licences ask for, and their labels.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights to this work"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BETWEEN_IN_LINE = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"


def spaced(text: Column) -> Column:
    """The words of a text, each with a space on either side; empty without words."""
    words = F.trim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), _BETWEEN, "  "))
    return F.when(words == "", "").otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def _n_words(s: Column) -> Column:
    return ((F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))) / 2).cast("long")


def vocabulary(texts: DataFrame, templates: list[tuple[str, str]]) -> list[str]:
    """The words of all templates, those that the fewest of all `texts` (text) hold first.

    Only these words are counted: what reaches the driver is a number for each of them.
    """
    own = sorted({w for _, t in templates for w in t.split()})
    words = F.split(F.translate("text", _UPPER, _LOWER), _BETWEEN)
    seen = texts.select(F.explode(F.array_intersect(words, F.lit(own))).alias("w")).groupBy("w").count()
    n = {r["w"]: r["count"] for r in seen.collect()}
    return sorted(own, key=lambda w: (n.get(w, 0), w))


def ranked(templates: list[tuple[str, str]], order: list[str], threshold: float) -> list[tuple[str, list[int], int, int]]:
    """(label, places of the distinct words in `order`, least overlap, length in words) of each template."""
    out = []
    for label, t in templates:
        own = sorted(order.index(w) + 1 for w in set(t.split()))
        out.append((label, own, ceil(threshold * len(own) - 1e-9), len(t.split())))
    return out


def _places(words: Column, order: list[str]) -> Column:
    return F.sort_array(F.transform(F.array_intersect(words, F.lit(order)), lambda w: F.array_position(F.lit(order), w).cast("int")))


def _matches(blocks: Column, order: list[str], templates: list[tuple[str, list[int], int, int]], windows: bool = False) -> Column:
    """An array of (label, containment) of every block of words and template that meet the threshold; with `windows`, of a block's best
    window."""
    fewest = min((least for _, _, least, _ in templates), default=0)

    def of_block(block: Column) -> Column:
        own_places, words = block["places"], block["words"]
        found = []
        for label, own, least, n in templates:
            prefix = own[: len(own) - least + 1]
            left = lambda i, own=own, prefix=prefix: F.least(F.lit(len(own) - i), F.size(own_places) - F.array_position(own_places, prefix[i]).cast("int") + 1)
            bound = F.coalesce(*(F.when(F.array_contains(own_places, prefix[i]), left(i)) for i in range(len(prefix))), F.lit(0))
            shared = F.size(F.array_intersect(own_places, F.lit(own)))
            passed = (F.size(own_places) >= least) & (bound >= least) & (shared >= least)
            if windows:
                starts = F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1)), F.lit(n))
                kept = [order[k - 1] for k in own]
                shared = F.array_max(F.transform(starts, lambda i: F.size(F.array_intersect(F.slice(words, i, 2 * n), F.lit(kept)))))  # noqa: B023
            share = F.when(passed, shared / len(own))
            found.append(F.when(share >= least / len(own), F.struct(F.lit(label).alias("label"), share.alias("containment"))))
        return F.array_compact(F.array(*found))

    placed = F.transform(blocks, lambda words: F.struct(words.alias("words"), _places(words, order).alias("places")))
    return F.flatten(F.transform(F.filter(placed, lambda b: F.size(b["places"]) >= fewest), of_block))


def licence_scan(docs: DataFrame, phrases: list[tuple[str, str]] | None = None, templates: list[tuple[str, str]] | None = None, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every document, one row for each row.

    score: 1 with a base phrase, else the greatest containment of a template that a line or a window over lines meets, else 0. Texts are
    taken whole. A null text is an empty one: no words, no labels, score 0. A null id stays null; repeated rows are scanned alike; of
    templates with one label that meet a text, the nearest counts. Extra columns, whatever their names, are not read; an empty table
    gives none back.
    """
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    text = F.coalesce(F.col("text"), F.lit(""))
    whole = docs.select("doc_id", text.alias("text"))
    order = vocabulary(whole, templates)
    ranks = ranked(templates, order, threshold)
    spread = whole.select("doc_id", "text", spaced(F.col("text")).alias("s")).withColumn("words", F.split("s", "  ?"))
    prefixes = [order[k - 1] for k in sorted({k for _, own, least, _ in ranks for k in own[: len(own) - least + 1]})]
    low = F.regexp_replace(F.translate(F.col("text"), _UPPER, _LOWER), _BETWEEN_IN_LINE, " ")
    lines = F.transform(F.split(low, "\n"), lambda line: F.array_distinct(F.split(F.trim(line), " ")))
    wrapped = F.filter(F.transform(F.split(low, "\n ?\n"), lambda p: F.trim(p, F.lit(" \n"))), lambda p: p.contains("\n"))
    paragraphs = F.transform(wrapped, lambda p: F.split(p, "[ \n]+"))
    near = lambda blocks: F.filter(blocks, lambda words: F.arrays_overlap(words, F.lit(prefixes)))
    met = F.concat(_matches(near(lines), order, ranks), _matches(near(paragraphs), order, ranks, windows=True))
    s = F.col("s")
    marked = [(f" {p.replace(' ', '  ')} ", p, label) for p, label in phrases]
    places = [(F.length(s) - F.length(F.replace(s, F.lit(m), F.lit("")))) / len(m) for m, _, _ in marked]
    counted = spread.select(
        "doc_id",
        _n_words(s).alias("n_words"),
        *(n.cast("long").alias(f"_n{i}") for i, n in enumerate(places)),
        *(F.when(s.contains(m), _n_words(F.substring_index(s, m, 1))).alias(f"_a{i}") for i, (m, _, _) in enumerate(marked)),
        *(F.when(s.contains(m), _n_words(s) - _n_words(F.substring_index(s, m, -1)) - len(p.split())).alias(f"_z{i}") for i, (m, p, _) in enumerate(marked)),
        F.when(F.arrays_overlap("words", F.lit(prefixes)), met).alias("_met"),
    )
    i = range(len(phrases))
    base = F.array_compact(F.array(*(F.when(F.col(f"_n{k}") > 0, F.lit(phrases[k][1])) for k in i)))
    own = F.coalesce(F.col("_met.label"), F.array().cast("array<string>"))
    n_base = sum((F.col(f"_n{k}") for k in i), F.lit(0).cast("long"))
    return counted.select(
        "doc_id",
        "n_words",
        n_base.alias("n_base"),
        F.array_min(F.array_compact(F.array(*(F.col(f"_a{k}") for k in i)))).alias("first_word"),
        F.array_max(F.array_compact(F.array(*(F.col(f"_z{k}") for k in i)))).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, own))), ",").alias("labels"),
        F.when(n_base > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.col("_met.containment")), F.lit(0.0))).alias("score"),
    )

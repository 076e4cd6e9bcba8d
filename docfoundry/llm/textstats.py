"""Counts over whole texts, for many texts at once."""

from __future__ import annotations

import numpy as np

from . import common as C

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[list(b".,;:?\"'()")] = True


def _fresh(text: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each hash's value within its text, and how often each value stands there."""
    _, inv, n = np.unique(C.mix(h ^ C.mix(text.astype(np.uint64) + np.uint64(1))), return_inverse=True, return_counts=True)
    return inv, n


def _count(text: np.ndarray, n: int, weights=None) -> np.ndarray:
    return np.bincount(text, weights, n)[:n]


def rules(b: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text.

    A word is a run of bytes other than space and 0x09-0x0D. A text without words has zeros.
    """
    k = len(off) - 1
    space = C.SPACE[b]
    s, e, t = C.spans(space, off)
    p = C.prefix_hash(b)
    w = C.span_hash(p, s, e)
    ls, le, lt = C.spans(b == 10, off)
    filled = np.concatenate([[0], np.cumsum(~space)])
    has = filled[le] > filled[ls]
    ls, le, lt = ls[has], le[has], lt[has]
    inv, _ = _fresh(lt, C.span_hash(p, ls, le))
    first = np.zeros(len(lt), bool)
    first[np.unique(inv, return_index=True)[1]] = True
    at, h = C.windows(w, t, 8)
    inv, n = _fresh(t[at], h)
    cover = np.zeros(len(w) + 1, np.int64)
    hit = at[n[inv] > 1] if len(at) else at
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + 8, -1)
    repeated = t[np.cumsum(cover[:-1]) > 0]
    return {
        "n_words": _count(t, k),
        "word_chars": C.per_text(~space & ((b & 0xC0) != 0x80), off),
        "n_symbols": C.per_text(_SYMBOL[b], off),
        "n_dup_lines": _count(lt[~first], k),
        "n_repeat_words": _count(repeated, k),
        "_words": (w, s, e, t),
    }


#: Names of the columns of statistics().
STATISTICS = [
    "log_words", "mean_word", "sd_word", "upper", "symbol", "bar", "bang", "digit", "punct", "beyond_ascii", "distinct_words",
    "top_word", "repeat_words", "dup_lines", "words_per_line", "capital_words", "short_words", "distinct_pairs", "same_next", "symbol_ends",
]


def statistics(b: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text: logarithms of counts and log-odds of shares. An empty text has the least values."""
    k = len(off) - 1
    r = rules(b, off)
    w, s, e, t = r["_words"]
    n = np.maximum(r["n_words"], 1).astype(float)
    size = np.maximum(np.diff(off), 1).astype(float)
    chars = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])
    length = (chars[e] - chars[s]).astype(float)
    mean = _count(t, k, length) / n
    sd = np.sqrt(np.maximum(_count(t, k, length**2) / n - mean**2, 0))
    inv, times = _fresh(t, w)
    kind = np.zeros(len(times), np.int64)
    kind[inv] = t
    top = np.zeros(k)
    np.maximum.at(top, kind, times)
    at, h = C.windows(w, t, 2)
    inv2, times2 = _fresh(t[at], h)
    kind2 = np.zeros(len(times2), np.int64)
    kind2[inv2] = t[at]
    pairs = np.maximum(n - 1, 1)
    same = at[w[at] == w[at + 1]] if len(at) else at
    first, last = (b[s], b[e - 1]) if len(s) else (np.zeros(0, np.uint8),) * 2
    upper = (b >= 65) & (b <= 90)
    lines = C.per_text(b == 10, off) + 1.0
    odds = lambda x: np.log((x + 1e-3) / (1 - np.minimum(x, 1) + 1e-3))
    share = lambda m: odds(C.per_text(m, off) / size)
    of_words = lambda m: odds(_count(t[m], k) / n)
    return np.column_stack([
        np.log1p(r["n_words"]), np.log1p(mean), np.log1p(sd), share(upper), share(_SYMBOL[b]), share(b == 124), share(b == 33),
        share((b >= 48) & (b <= 57)), share(_PUNCT[b]), share(b >= 128), odds(_count(kind, k) / n), odds(top / n),
        odds(r["n_repeat_words"] / n), odds(r["n_dup_lines"] / lines), np.log1p(n / lines), of_words((first >= 65) & (first <= 90)),
        of_words(length <= 3), odds(_count(kind2, k) / pairs), odds(_count(t[same], k) / pairs), of_words(_SYMBOL[last]),
    ])


def hashed(b: np.ndarray, off: np.ndarray, bits: int = 11) -> np.ndarray:
    """Hashed word 1- and 2-grams and character 3-grams: square roots of shares, 2 * 2^bits columns for each text.

    Squares of a text's values in either half add up to 1, however long the text; a text without words has zeros.
    """
    k, d = len(off) - 1, 1 << bits
    s, e, t = C.spans(C.SPACE[b], off)
    w = C.span_hash(C.prefix_hash(b), s, e)
    at, h = C.windows(w, t, 2)
    place = np.concatenate([t, t[at]]) * d + (np.concatenate([w, h]) >> np.uint64(64 - bits)).astype(np.int64)
    words = np.bincount(place, minlength=k * d).reshape(k, d)
    n = len(b) - 2
    if n > 0:
        code = (b[:n].astype(np.uint32) | b[1 : n + 1].astype(np.uint32) << np.uint32(8) | b[2 : n + 2].astype(np.uint32) << np.uint32(16)) * np.uint32(0x9E3779B1)
        of = np.repeat(np.arange(k), np.diff(off))
        whole = of[:n] == of[2:]
        chars = np.bincount((of[:n] * d + (code >> np.uint32(32 - bits)))[whole].astype(np.int64), minlength=k * d).reshape(k, d)
    else:
        chars = np.zeros((k, d), np.int64)
    part = lambda c: np.sqrt(c / np.maximum(c.sum(1, keepdims=True), 1)).astype(np.float32)
    return np.concatenate([part(words), part(chars)], axis=1)

"""Quality rules: exact counts against fixed limits, then a calibrated logistic regression on hashed n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import textstats

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_KIND = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,base_failed:boolean,score:double,kept:boolean>"


@dataclass(frozen=True)
class Model:
    """Weights over hashed n-grams, and the two numbers that turn their sum into a calibrated probability."""

    weights: np.ndarray
    slope: float
    offset: float
    bits: int

    def score(self, b: np.ndarray, off: np.ndarray) -> np.ndarray:
        z = textstats.hashed(b, off, self.bits) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, l2: float, steps: int) -> np.ndarray:
    """Weights and, last, the intercept of a ridge logistic regression, by accelerated gradient steps."""
    x1 = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1)
    step = 1 / (0.25 * float((x1**2).sum(1).mean()) + l2)
    w = v = np.zeros(x1.shape[1], x1.dtype)
    ridge = np.full(len(w), l2, x1.dtype)
    ridge[-1] = 0
    for i in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ v, -30, 30)))
        new = v - step * (x1.T @ (p - y).astype(x1.dtype) / len(y) + ridge * v)
        w, v = new, new + (i / (i + 3)) * (new - w)
    return w.astype(float)


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a one-dimensional logistic fit, with targets drawn a little towards the middle."""
    pos = (y == 1).sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (len(y) - pos + 2))
    a = np.column_stack([z, np.ones(len(z))])
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = a.T @ (a * (p * (1 - p) + 1e-6)[:, None]) + 1e-6 * np.eye(2)
        w = w - np.clip(np.linalg.solve(h, a.T @ (p - t)), -2, 2)
    return float(w[0]), float(w[1])


def train(docs: DataFrame, labels: DataFrame, rows: int = 4000, bits: int = 11, l2: float = 2e-5, steps: int = 300) -> Model:
    """Fit on at most `rows` labelled rows, none with crc32(doc_id) mod 5 = 0; a fifth of them set the calibration only.

    Without rows of both classes, every text scores the share of label 1 (1 without any label).
    """

    @F.arrow_udf("binary")
    def features(text: pa.Array) -> pa.Array:
        return pa.array([row.tobytes() for _, b, off in C.blocks(text) for row in textstats.hashed(b, off, bits).astype(np.float16)], pa.binary())

    got = C.labelled_sample(docs, labels, "quality", rows).select("y", features("text").alias("x"), (F.crc32(F.col("doc_id").cast("string")) % 25 < 5).alias("aside")).toArrow()
    y = np.array(got["y"].to_pylist(), float)
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float16).reshape(len(y), 2 << bits).astype(np.float32)
    aside = np.array(got["aside"].to_pylist(), bool)
    if len(np.unique(y[~aside])) < 2:
        return Model(np.zeros((2 << bits) + 1), 0.0, 30.0 if not len(y) else float(np.log((y.sum() + 1e-9) / (len(y) - y.sum() + 1e-9))), bits)
    w = logistic(x[~aside], y[~aside], l2, steps)
    on = aside if len(np.unique(y[aside])) == 2 else ~aside
    return Model(w, *platt(x[on] @ w[:-1] + w[-1], y[on]), bits)


def judge(text: Column, model: Model, least_words: int = 20, repeat_percent: int = 30, threshold: float = 0.3) -> Column:
    """A struct of the five counts, base_failed, score (0 to 1, higher: better) and kept.

    base_failed: fewer than `least_words` words, or over `repeat_percent` in a hundred of them in 8-word windows found twice.
    kept: not base_failed, and the score is `threshold` at least. A null text counts as empty: zeros, base_failed, not kept.
    """

    @F.arrow_udf(_KIND)
    def scored(texts: pa.Array) -> pa.Array:
        parts: list[list[np.ndarray]] = []
        for _, b, off in C.blocks(texts):
            r = textstats.rules(b, off)
            parts.append([*(r[c] for c in COUNTS), model.score(b, off)])
        n_words, word_chars, n_symbols, n_dup, n_repeat, score = (np.concatenate(x) for x in zip(*parts)) if parts else [np.zeros(0)] * 6
        failed = (n_words < least_words) | (100 * n_repeat > repeat_percent * n_words)
        counts = [pa.array(x.astype(np.int64)) for x in (n_words, word_chars, n_symbols, n_dup, n_repeat)]
        return pa.StructArray.from_arrays([*counts, pa.array(failed), pa.array(score.astype(float)), pa.array(~failed & (score >= threshold))], [*COUNTS, "base_failed", "score", "kept"])

    return scored.asNondeterministic()(text)  # so that the planner never runs it twice


def quality_rules(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, the counts, base_failed, kept and score of every document, one row for each row.

    Rows with a null id stay, with that null; a null or empty text has no words and fails; texts are taken whole; repeated rows are judged
    alike. Extra columns, whatever their names, are not read; an empty table gives none back.
    """
    docs = C.bounded_batches(docs)
    q = docs.select("doc_id", judge(F.col("text"), train(docs, labels), **options).alias("q"))
    return q.select("doc_id", *(f"q.{c}" for c in [*COUNTS, "base_failed", "kept", "score"]))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that quality_rules() keeps, with all their columns, whatever their names. Null and empty texts go; null ids and
    repeated rows stay if their texts do."""
    if "text" not in docs.columns:
        raise ValueError("documents need a column text")
    docs = C.bounded_batches(docs)
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    judged = docs.select(whole.alias("d"), judge(F.col("text"), train(docs, labels), **options).alias("q"))
    return judged.filter("q.kept").select("d.*")

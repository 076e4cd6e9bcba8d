"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import textstats
from .quality_rules import platt


@dataclass(frozen=True)
class Discriminant:
    """Scale of the statistics; mean, inverse Cholesky factor and log-determinant of either class; the calibration."""

    centre: np.ndarray
    scale: np.ndarray
    classes: tuple[tuple[np.ndarray, np.ndarray, float], ...]
    slope: float
    offset: float

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1 less that of class 0."""
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        density = [-0.5 * ((((z - mean) @ factor.T) ** 2).sum(1) + log_det) for mean, factor, log_det in self.classes]
        return density[1] - density[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.classes:
            return np.full(len(x), self.offset)
        return 1 / (1 + np.exp(-np.clip(self.slope * np.arcsinh(self.difference(x)) + self.offset, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, to_pooled: float = 0.1, to_sphere: float = 0.02) -> Discriminant:
    """Each class's covariance, drawn towards the pooled one and then towards a multiple of the identity.

    With fewer than two rows of a class every text scores the share of label 1 (1 without rows).
    """
    if min((y == 1).sum(), (y == 0).sum()) < 2:
        return Discriminant(np.zeros(0), np.ones(0), (), 0.0, float(y.mean()) if len(y) else 1.0)
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = np.clip((x - centre) / scale, -8, 8)
    d = z.shape[1]
    own = [np.cov(z[y == c], rowvar=False, bias=True) for c in (0, 1)]
    share = [np.mean(y == c) for c in (0, 1)]
    pooled = share[0] * own[0] + share[1] * own[1]
    classes = []
    for c in (0, 1):
        s = (1 - to_pooled) * own[c] + to_pooled * pooled
        s = (1 - to_sphere) * s + to_sphere * np.trace(s) / d * np.eye(d)
        factor = np.linalg.cholesky(s)
        classes.append((z[y == c].mean(0), np.linalg.inv(factor), 2 * float(np.log(np.diag(factor)).sum())))
    model = Discriminant(centre, scale, tuple(classes), 1.0, 0.0)
    slope, offset = platt(np.arcsinh(model.difference(x)), y)
    return Discriminant(centre, scale, tuple(classes), slope, offset)


def _features(texts: pa.Array) -> np.ndarray:
    parts = [textstats.statistics(b, off) for _, b, off in C.blocks(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, len(textstats.STATISTICS)))


def train(docs: DataFrame, labels: DataFrame, rows: int = 8000) -> Discriminant:
    """Fit on at most `rows` labelled rows, none with crc32(doc_id) mod 5 = 0."""

    @F.arrow_udf("binary")
    def features(text: pa.Array) -> pa.Array:
        return pa.array([row.tobytes() for row in _features(text)], pa.binary())

    got = C.labelled_sample(docs, labels, "quality", rows).select("y", features("text").alias("x")).toArrow()
    y = np.array(got["y"].to_pylist(), float)
    return fit(np.frombuffer(b"".join(got["x"].to_pylist()), float).reshape(len(y), len(textstats.STATISTICS)), y)


def score(text: Column, model: Discriminant) -> Column:
    """The probability of label 1; a null text is scored as an empty one."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(_features(texts)))

    return scored.asNondeterministic()(text)


def quality_classifier(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = 8000) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, one row for each row.

    held_out: crc32(doc_id as text) mod 5 is 0 (false for a null id). Only text goes into a score: copies score alike. Texts are taken
    whole; a null text is scored as an empty one, which has a score too; null ids and repeated rows stay. Extra columns, whatever their
    names, are not read. An empty table gives no rows; without labels of both classes every text scores the share of label 1.
    """
    docs = C.bounded_batches(docs)
    scored = docs.select("doc_id", score(F.col("text"), train(docs, labels, rows)).alias("score"))
    return scored.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )

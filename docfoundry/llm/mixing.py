"""Soft-membership mixing: domain posteriors of every document, then nonnegative rates that bring token totals to target weights.

With v_d the document's share of all tokens, p_dk its posteriors, w_k the targets and M = sum_d v_d p_d p_d', the rates r_d >= 0
minimise the distance of sum_d v_d r_d p_d from w in the metric of the inverse of M, beginning at 1. In the metric of v_d a gradient
step for one document needs its own posteriors and the k residuals only, and a step of length 1 goes all the way as long as no rate
is cut off at 0. So a pass over the documents replays the residuals of the few steps so far to get each rate, and sums the k new
ones: no rate is stored, moved or gathered.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import textstats


@dataclass(frozen=True)
class Domains:
    """A softmax regression over hashed n-grams of the text."""

    names: list[str]
    weights: np.ndarray
    bits: int

    def posteriors(self, b: np.ndarray, off: np.ndarray) -> np.ndarray:
        z = textstats.hashed(b, off, self.bits) @ self.weights[:-1] + self.weights[-1]
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def train(docs: DataFrame, labelled: DataFrame, rows: int = 4000, bits: int = 9, steps: int = 200, l2: float = 1e-5) -> Domains:
    """Fit on at most `rows` rows of the labelled table (doc_id, domain), those with the smallest hash of their id."""

    @F.arrow_udf("binary")
    def features(text: pa.Array) -> pa.Array:
        return pa.array([row.tobytes() for _, b, off in C.blocks(text) for row in textstats.hashed(b, off, bits).astype(np.float16)], pa.binary())

    picked = labelled.filter("doc_id is not null and domain is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.min(F.col("domain").cast("string")).alias("domain")).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    got = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select("domain", features("text").alias("x")).toArrow()
    names = sorted(set(got["domain"].to_pylist()))
    if not names:
        return Domains(["all"], np.zeros(((2 << bits) + 1, 1)), bits)
    y = np.eye(len(names))[[names.index(d) for d in got["domain"].to_pylist()]]
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float16).reshape(len(y), 2 << bits).astype(np.float32)
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    step = 1 / (0.5 * float((x**2).sum(1).mean()) + l2)
    w = v = np.zeros((x.shape[1], len(names)), np.float32)
    for i in range(steps):
        z = x @ v
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        new = v - step * (x.T @ (p - y).astype(np.float32) / len(y) + l2 * v)
        w, v = new, new + (i / (i + 3)) * (new - w)
    return Domains(names, w.astype(float), bits)


def membership(text: Column, model: Domains) -> Column:
    """A struct of n_tokens (runs of other than space and 0x09-0x0D) and posteriors, in the order of model.names."""

    @F.arrow_udf("struct<n_tokens:bigint,posteriors:array<double>>")
    def of(texts: pa.Array) -> pa.Array:
        n, p = [np.zeros(0, np.int64)], [np.zeros((0, len(model.names)))]
        for _, b, off in C.blocks(texts):
            _, _, t = C.spans(C.SPACE[b], off)
            n.append(np.bincount(t, minlength=len(off) - 1).astype(np.int64))
            p.append(model.posteriors(b, off))
        n, p = np.concatenate(n), np.concatenate(p)
        return pa.StructArray.from_arrays([pa.array(n), pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))], ["n_tokens", "posteriors"])

    return of.asNondeterministic()(text)


@dataclass
class Rates:
    """The steps taken so far, each a residual for each domain times the inverse of M; targets and what the rates achieve, as shares of
    all tokens by domain; whether they are as near as was asked."""

    steps: list[np.ndarray] = field(default_factory=list)
    targets: np.ndarray | None = None
    achieved: np.ndarray | None = None
    converged: bool = True

    def __call__(self, p: np.ndarray) -> np.ndarray:
        r = np.ones(len(p))
        for e in self.steps:
            r = np.maximum(0, r - p @ e)
        return r


def rate(posteriors: Column, rates: Rates) -> Column:
    @F.arrow_udf("double")
    def of(p: pa.Array) -> pa.Array:
        return pa.array(rates(p.flatten().to_numpy().reshape(len(p), -1)) if len(p) else np.zeros(0))

    return of(posteriors)


def rate_of_text(text: Column, model: Domains, rates: Rates) -> Column:
    """The rate of a text, in one function: one worker a task."""

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0), *(rates(model.posteriors(b, off)) for _, b, off in C.blocks(texts))]))

    return of.asNondeterministic()(text)


def solve(members: DataFrame, names: list[str], targets: dict[str, float] | None, power: float, most: int, near: float) -> Rates:
    """Projected-gradient steps over members (n_tokens, posteriors) until every domain is within `near` of its target.

    Targets that no rates can reach, or that `most` steps don't, end with the nearest rates and a warning.
    """

    def totals(rates: Rates) -> tuple[np.ndarray, np.ndarray]:
        """The expected tokens of each domain, and of each pair of domains the tokens that M weighs."""

        def sums(batches):
            for batch in batches:
                if batch.num_rows:
                    p, n = batch.column("posteriors").flatten().to_numpy().reshape(batch.num_rows, -1), np.array(batch.column("n_tokens"))
                    both = p.T @ (p * n[:, None]) if not rates.steps else np.zeros((0, 0))
                    found = np.concatenate([(n * rates(p)) @ p, both.ravel()])
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(found)), pa.int32()), pa.array(found)], ["k", "s"])

        got = {k: s for k, s in members.mapInArrow(sums, "k int, s double").groupBy("k").agg(F.sum("s")).collect()}
        found = np.array([got.get(k, 0.0) for k in range(len(names) * (1 + len(names)))])
        return found[: len(names)], found[len(names) :].reshape(len(names), -1)

    rates = Rates()
    have, both = totals(rates)
    everything = have.sum()
    rates.achieved = rates.targets = have
    if not everything:
        return rates
    q, inverse = have / everything, np.linalg.pinv(both / everything, rcond=1e-9, hermitian=True)
    want = np.array([targets.get(k, 0.0) for k in names]) if targets else q**power
    rates.targets, rates.achieved = want / want.sum(), q
    stuck, before = 0, np.inf
    while True:
        residual = rates.achieved - rates.targets
        gap = float(np.abs(residual).max())
        rates.converged = gap <= near
        stuck = stuck + 1 if gap > 0.98 * before else 0
        if rates.converged or stuck == 5 or len(rates.steps) == most:
            break
        before = min(gap, before)
        rates.steps.append(inverse @ residual)
        rates.achieved = totals(rates)[0] / everything
    if not rates.converged:
        warnings.warn(f"rates end {gap:.2g} from the targets after {len(rates.steps)} steps", stacklevel=2)
    return rates


def fit(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, power: float = 0.5, most: int = 60, near: float = 1e-4, rows: int = 4000) -> tuple[Domains, DataFrame, Rates]:
    """The classifier, (doc_id, n_tokens, posteriors) of every document, and the rates.

    targets: shares of all tokens by domain; without them, the domains' own shares to this power, made to add up to 1. The total
    number of expected tokens stays.
    """
    docs = C.bounded_batches(docs)
    model = train(docs, labelled, rows)
    m = docs.select("doc_id", membership(F.col("text"), model).alias("m")).select("doc_id", "m.n_tokens", "m.posteriors")
    members = C.materialise(m, "members", docs.count(), 8_000, narrow=True)
    return model, members, solve(members, model.names, targets, power, most, near)


def copies(doc_id: Column, r: Column, key: str) -> Column:
    """A whole number of copies whose expectation is the rate: rounded up for the share of documents whose keyed hash says so."""
    return F.floor(r + F.pmod(F.xxhash64(doc_id, F.lit(key)), F.lit(1 << 40)) / float(1 << 40)).cast("int")


def mix(docs: DataFrame, labelled: DataFrame, key: str = "mix", **options) -> DataFrame:
    """doc_id, n_tokens, domains, posteriors, rate and copies of every document, one row for each row; and, the same in all rows, targets
    and achieved (shares of all tokens in the order of domains) and converged.

    A null or empty text has no tokens and the classifier's posteriors of an empty text; texts are taken whole. A null id has copies like
    any other. Repeated rows are rated alike. Without labelled rows there is one domain. Extra columns, whatever their names, are not
    read; an empty table gives none back.
    """
    model, members, rates = fit(docs, labelled, **options)
    out = members.withColumn("rate", rate(F.col("posteriors"), rates))
    shares = [F.lit([float(x) for x in v]).cast("array<double>").alias(k) for k, v in (("targets", rates.targets), ("achieved", rates.achieved))]
    return out.select("doc_id", "n_tokens", F.lit(model.names).alias("domains"), "posteriors", "rate", copies(F.col("doc_id"), F.col("rate"), key).alias("copies"), *shares, F.lit(rates.converged).alias("converged"))


def apply_mix(docs: DataFrame, labelled: DataFrame, key: str = "mix", **options) -> DataFrame:
    """The documents, each as often as copies() says, with all their columns, whatever their names. Ids repeat from here on.

    Posteriors are taken from the text once more: ids needn't be unique, so a join with the members would shuffle whole texts.
    """
    model, _, rates = fit(docs, labelled, **options)
    r = rate_of_text(F.col("text"), model, rates)
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    times = docs.select(whole.alias("d"), r.alias("r")).select("d", copies(F.col("d.doc_id"), F.col("r"), key).alias("k")).filter("k > 0")
    return times.select("d", F.explode(F.sequence(F.lit(1), F.col("k")))).select("d.*")

"""Product codes of vectors: integer codebooks for parts of vectors, trained and searched exactly.

The nearest entry is found by equal-average search. Entries are sorted by the sum of their components, and looked at outward from the sum
of the part. By Cauchy-Schwarz the squared gap of two sums is at most the dimension times the squared distance, so an entry whose squared
gap over the dimension strictly exceeds the best distance can be neither nearer nor as near, and with it all entries beyond it.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, join_weighted

FAR = 1 << 62  #: components are held to -FAR .. FAR
_LONG = (1 << 63) - 1


def safe(d: int) -> int:
    """Components below this have squared gaps of sums, over d of them, that 64 bits hold."""
    return (1 << 30) // max(1, d)


class Codebook:
    """Entries of one part position, (entries, dimension), sorted by their sums for the search."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.d = entries, max(1, entries.shape[1])
        sums = entries.sum(axis=1)
        self.order = np.array(sorted(range(len(entries)), key=lambda i: (sums[i], i)), np.int64)
        self.sums = sums[self.order]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each part (ties: the lower) and its squared distance."""
        if self.entries.dtype == object:
            parts = parts.astype(object)
        n, last = len(parts), len(self.order)
        sums = parts.sum(axis=1)
        up = np.searchsorted(self.sums, sums)
        down = up - 1
        best, index = np.full(n, -1, parts.dtype), np.full(n, last, np.int64)
        open_ = np.arange(n)
        while len(open_):
            # the nearer of the two entries next in line, by sums
            u, v = up[open_], down[open_]
            above, below = self.sums[np.minimum(u, last - 1)] - sums[open_], sums[open_] - self.sums[np.maximum(v, 0)]
            take_up = (v < 0) | (u < last) & (above <= below)
            gap = np.where(take_up, above, below)
            go = ((u < last) | (v >= 0)) & ((best[open_] < 0) | (gap * gap <= self.d * best[open_]))
            open_, take_up = open_[go], take_up[go]
            at = self.order[np.where(take_up, up[open_], down[open_])]
            apart = parts[open_] - self.entries[at]
            far = (apart * apart).sum(axis=1)
            better = (best[open_] < 0) | (far < best[open_]) | (far == best[open_]) & (at < index[open_])
            best[open_[better]], index[open_[better]] = far[better], at[better]
            up[open_[take_up]] += 1
            down[open_[~take_up]] -= 1
        return index, best


def cuts(dim: int, parts: int) -> list[tuple[int, int]]:
    """Where the parts of a vector begin and end; if they can't be equal, the first ones are longer by one."""
    ends = np.cumsum([0, *(dim // parts + (k < dim % parts) for k in range(parts))]).tolist()
    return list(zip(ends, ends[1:]))


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def integers(flat: np.ndarray, scale: float, d: int) -> np.ndarray:
    """floor(scale * x): 64-bit where squares and sums over d components fit, else Python's own integers."""
    x = np.floor(np.float64(scale) * flat.astype(np.float64))
    if not len(x) or np.abs(x).max() < safe(d):
        return x.astype(np.int64)
    return np.array([int(min(max(v, -FAR), FAR)) for v in x.tolist()], object)


def _vectors(column: pa.Array, dim: int, scale: float, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a list column have `dim` components, and the integers of those."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    fits = np.flatnonzero(sizes == dim)
    flat = column.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False)
    return fits, integers(flat, scale, d).reshape(len(fits), dim)


def _sums(vectors: DataFrame, books: list[np.ndarray], dim: int, scale: float) -> list[tuple[int, int, int, list[int]]]:
    """(part, entry, number of parts, their sums) over all vectors: each task adds up its own, so that only as many rows as the
    codebooks have components leave it. What comes to the driver is as large as the codebooks."""
    spans = cuts(dim, len(books))
    width = max(b - a for a, b in spans)

    def add(batches):
        searched = [Codebook(b) for b in books]
        n = [np.zeros(len(b), np.int64) for b in books]
        total = [np.zeros(b.shape, object) for b in books]
        for batch in batches:
            _, x = _vectors(batch.column(0), dim, scale, width)
            for k, (a, b) in enumerate(spans):
                index, _ = searched[k].nearest(x[:, a:b])
                n[k] += np.bincount(index, minlength=len(books[k]))
                for i in np.unique(index):
                    total[k][i] += x[index == i, a:b].sum(axis=0)
        rows = [(k, i, int(n[k][i]), [*map(int, total[k][i])]) for k in range(len(books)) for i in range(len(books[k])) if n[k][i]]
        kind = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string()))])
        yield pa.RecordBatch.from_pylist([{"part": k, "entry": i, "n": c, "sums": [*map(str, s)]} for k, i, c, s in rows], kind)

    found = vectors.select("v").mapInArrow(add, "part int, entry int, n long, sums array<string>")
    each = [F.sum(F.get("sums", F.lit(j)).cast("decimal(38,0)")).alias(f"s{j}") for j in range(width)]
    # many components: one row for each instead of as many aggregates
    if width <= 64:
        rows = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *each).collect()
        return [(r["part"], r["entry"], r["n"], [int(r[f"s{j}"]) for j in range(spans[r["part"]][1] - spans[r["part"]][0])]) for r in rows]
    rows = found.select("part", "entry", "n", F.posexplode("sums").alias("j", "s")).groupBy("part", "entry", "j").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    by: dict[tuple[int, int], dict[int, tuple[int, int]]] = {}
    for r in rows:
        by.setdefault((r["part"], r["entry"]), {})[r["j"]] = (r["n"], int(r["s"]))
    return [(k, i, s[0][0], [s[j][1] for j in range(len(s))]) for (k, i), s in by.items()]


def _smallest(vectors: DataFrame, most: int) -> list:
    """The `most` smallest distinct ids that aren't null; each task hands on its own."""

    def first(batches):
        ids = None
        for b in batches:
            new = b.column(0) if ids is None else pa.concat_arrays([ids, b.column(0)])
            new = pc.drop_null(pc.unique(new))
            ids = new.take(pc.sort_indices(new)[:most])
        if ids is not None:
            yield pa.RecordBatch.from_arrays([ids], ["vec_id"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return [r[0] for r in vectors.select("vec_id").mapInArrow(first, f"vec_id {kind}").distinct().orderBy("vec_id").limit(most).collect()]


def train(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: float = 4096.0) -> list[np.ndarray]:
    """Codebooks of vectors (vec_id, v), all of them usable, one for each part position.

    Codebooks start as the parts of the vectors with the smallest distinct ids (of one id the smallest vector; null ids start none), whose
    first gives the dimension; vectors of another are left out. A round replaces each entry by the floor of the mean of the parts nearest
    to it; one that is nearest to none stays. No vectors: no entries.
    """
    if entries > 256:
        raise ValueError("a code holds two hex digits for each part: 256 entries at most")
    first = vectors.filter(F.col("vec_id").isin(_smallest(vectors, entries))).groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").collect()
    dim = len(first[0]["v"]) if first else 0
    if not dim:
        return [np.zeros((0, 0), np.int64)] * parts
    spans = cuts(dim, parts)
    start = np.stack([integers(np.array(r["v"], np.float64), scale, dim).astype(object) for r in first if len(r["v"]) == dim])
    books = [_narrow(start[:, a:b]) for a, b in spans]
    for _ in range(rounds):
        new = [b.astype(object) for b in books]
        for k, i, n, sums in _sums(vectors, books, dim, scale):
            new[k][i] = [s // n for s in sums]
        books = [_narrow(b) for b in new]
    return books


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64) if all(abs(v) < safe(x.shape[1]) for v in x.flat) else x


def encode(vectors: DataFrame, books: list[np.ndarray], scale: float = 4096.0) -> DataFrame:
    """The rows (vec_id, label, v) with code (two hex digits for each part) and error (squared distances to the entries, summed) instead
    of v. Both are null where a vector hasn't the codebooks' dimension; error is held to the largest long."""
    dim = sum(b.shape[1] for b in books)
    spans = cuts(dim, len(books))
    kept = [f for f in vectors.schema.fields if f.name != "v"]

    def coded(batches):
        searched = [Codebook(b) for b in books]
        for batch in batches:
            fits, x = _vectors(batch.column(batch.num_columns - 1), dim, scale, spans[0][1])
            codes, error = np.zeros((len(fits), len(books)), np.uint8), 0
            for k, (a, b) in enumerate(spans):
                index, far = searched[k].nearest(x[:, a:b])
                codes[:, k] = index
                error = error + far
            code, wrong = [None] * batch.num_rows, [None] * batch.num_rows
            for i, c, e in zip(fits.tolist(), codes, error):
                code[i], wrong[i] = c.tobytes().hex(), min(int(e), _LONG)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(code, pa.string()), pa.array(wrong, pa.int64())], [*(f.name for f in kept), "code", "error"])

    def empty(batches):
        for batch in batches:
            none = pa.nulls(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], none.cast(pa.string()), none.cast(pa.int64())], [*(f.name for f in kept), "code", "error"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return vectors.select(*(f.name for f in kept), "v").mapInArrow(coded if dim else empty, f"{types}, code string, error long")


def fingerprint(books: list[np.ndarray]) -> str:
    """Lower-case hex digest of all components in decimal, by part, entry and position, joined by commas."""
    return sha256(",".join(str(int(v)) for b in books for row in b for v in row).encode()).hexdigest()


def vector_codes(embeddings: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: float = 4096.0) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each row of (vec_id, embedding, label) whose vector is usable().

    A component x becomes floor(scale * x), held to -2^62 .. 2^62. label_error sums error over rows of equal labels, nulls together, and
    is held to the largest long. Rows whose vector is null or holds null or non-finite components are left out; those of another dimension
    than the codebooks' have null code and error. Null ids stay; repeated rows are coded alike; fewer vectors than entries make small
    codebooks; extra columns are not read; an empty table gives none back.
    """
    source = bounded_batches(embeddings, rows=4000).filter(usable(F.col("embedding"))).select("vec_id", "label", F.col("embedding").alias("v"))
    books = train(source.select("vec_id", "v"), parts, entries, rounds, scale)
    scratch = Scratch(embeddings.sparkSession)
    rows = scratch.keep(encode(source, books, scale).withColumn("label", F.array("label")), "codes")
    held = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONG).cast("decimal(38,0)")).cast("long")
    labels = rows.groupBy("label").agg(held.alias("label_error"), F.count("*").alias("n"))
    out = join_weighted(rows, labels, "label", "n", rows.count())
    return out.select("vec_id", "code", "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))


"""Near-duplicate vectors by a forest of random-projection trees.

Each tree halves the vectors again and again at the median of a random projection, one for each level; a vector within `spill` of a
cut, counted in standard deviations of what the cut divides, goes to both sides. Vectors of one leaf are compared, all of them, by
their cosine in double precision; a pair missed by one tree is found by another. Equal vectors are one class first, so copies are
neither split nor compared. Links are exact: none is below the threshold.

A vector travels with the leaves that it has in all trees, so the first leaf where two vectors meet is known where they are compared:
each link is counted once, there, and only a count for each vector and a local representative leave the task, not the pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .graph import components


@dataclass(frozen=True)
class Tree:
    """A direction for each level; the cuts and half-widths of the inner nodes, numbered 1, 2, 3 .. as in a heap."""

    directions: np.ndarray
    cuts: np.ndarray
    widths: np.ndarray

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of each leaf that each row of x belongs to."""
        row, node = np.arange(len(x)), np.ones(len(x), np.int64)
        for d in self.directions:
            above = (x @ d)[row] - self.cuts[node]
            left, right = above <= self.widths[node], above > -self.widths[node]
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
        return row, node


def grow(sample: np.ndarray, depth: int, spill: float, rng: np.random.Generator) -> Tree:
    """A tree whose cuts are medians over the sample; where a node has no sample left, the cut is 0."""
    directions = rng.normal(size=(depth, sample.shape[1]))
    directions /= np.maximum(np.linalg.norm(directions, axis=1, keepdims=True), 1e-300)
    cuts, widths = np.zeros(1 << depth), np.zeros(1 << depth)
    held = {1: np.arange(len(sample))}
    for level, d in enumerate(directions):
        p, below = sample @ d, {}
        for node, rows in held.items():
            at = p[rows]
            if len(rows):
                cuts[node], widths[node] = np.median(at), spill * at.std()
            below[2 * node], below[2 * node + 1] = rows[at <= cuts[node] + widths[node]], rows[at > cuts[node] - widths[node]]
        held = below
    return Tree(directions, cuts, widths)


def plan(n: int, leaf: int, threshold: float, spill: float, recall: float) -> tuple[int, int]:
    """(depth, trees) for n vectors: leaves of about `leaf` vectors, and as many trees as it takes that two vectors just at the threshold
    meet in one of them with probability `recall`, taking projections as normal."""
    rng = np.random.default_rng(1)
    z = rng.normal(size=200_000)
    y = threshold * z + np.sqrt(1 - threshold**2) * rng.normal(size=200_000)
    copies, parted = 1 + np.mean(np.abs(z) < spill), 2 * np.mean((z < -spill) & (y > spill))
    depth = int(np.ceil(max(0.0, np.log(max(n, 1) / leaf) / np.log(2 / copies))))
    together = (1 - parted) ** depth
    return depth, 1 if together >= recall else int(np.ceil(np.log(1 - recall) / np.log(1 - together)))


def _matrix(column: pa.Array) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _roots(size: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The smallest number that pairs (p, q) lead to, of 0 .. size - 1."""
    label = np.arange(size)
    while len(p):
        low = np.minimum(label[p], label[q])
        new = label.copy()
        np.minimum.at(new, label[p], low)
        np.minimum.at(new, label[q], low)
        np.minimum.at(new, p, low)
        np.minimum.at(new, q, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


_ROWS = "dim int, key long, rep long, n long, meets array<long>, embedding array<{}>"
_TREE = 1 << 40  #: keys of leaves: the tree's number times this, and the leaf's


def links(classes: DataFrame, threshold: float = 0.9, leaf: int = 3000, spill: float = 0.15, recall: float = 0.97, sample_bytes: int = 1 << 26, block: int = 4096, seed: int = 11) -> DataFrame:
    """(rep, root, k): for classes (rep, n, embedding) with a cosine of `threshold` at least to another one, how many vectors of other
    classes they are linked to, and a class that they are linked to directly or over others, by each leaf where pairs first meet.

    Trees are as deep and as many as plan() says, and grown on the classes with the smallest hashes: 32 for each leaf, at most what
    fits `sample_bytes`; beyond that trees end sooner and leaves grow. A leaf of more than `block` vectors is compared in pairs of
    blocks, each a task's group of its own.
    """
    kind = classes.schema["embedding"].dataType.elementType.simpleString()
    dims = {r["dim"]: r["count"] for r in classes.groupBy(F.size("embedding").alias("dim")).count().collect()}
    forest: dict[int, list[Tree]] = {}
    for dim, count in dims.items():
        depth, trees = plan(count, leaf, threshold, spill, recall)
        sample = min(32 << depth, sample_bytes // (4 * max(dim, 1)))
        depth = max(0, min(depth, int(np.log2(max(sample, 1) / 16)))) if depth else 0
        x = np.zeros((0, dim))
        if depth:
            picked = classes.filter(F.size("embedding") == dim).orderBy(F.xxhash64("rep", F.lit(seed))).limit(sample)
            x = _matrix(picked.select("embedding").toArrow()["embedding"])
        forest[dim] = [grow(x, depth, spill, np.random.default_rng([seed, dim, t])) for t in range(trees if depth else 1)]
    sent = classes.sparkSession.sparkContext.broadcast(forest)  # a direction for each level, two numbers for each inner node

    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            size = np.array(batch.column("embedding").value_lengths())
            for dim in np.unique(size):
                b = batch.take(pa.array(np.flatnonzero(size == dim)))
                x = _matrix(b.column("embedding"))
                found = [tree.leaves(x) for tree in sent.value[int(dim)]]
                row = np.concatenate([r for r, _ in found])
                key = np.concatenate([t * _TREE + node for t, (_, node) in enumerate(found)])
                order = np.lexsort((key, row))
                row, key = row[order], key[order]
                ends = np.searchsorted(row, np.arange(len(x) + 1))
                meets = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(key)).take(pa.array(row))
                some = b.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), dim), pa.int32()), pa.array(key), some.column("rep"), some.column("n"), meets, some.column("embedding")], ["dim", "key", "rep", "n", "meets", "embedding"])

    placed = classes.select("rep", "n", "embedding").mapInArrow(place, _ROWS.format(kind))
    # vectors are shuffled once; large leaves are no more than trees have leaves, which `sample_bytes` bounds
    large = placed.groupBy("dim", "key").count().filter(F.col("count") > block).select("dim", "key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    cut = placed.join(F.broadcast(large), ["dim", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("at", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    dealt = cut.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("at", "with"), "j": F.greatest("at", "with")})

    def compare(group: pa.Table) -> pa.Table:
        x, rep, n = _matrix(group["embedding"]), np.array(group["rep"]), np.array(group["n"])
        key, i, j, at = group["key"][0].as_py(), group["i"][0].as_py(), group["j"][0].as_py(), np.array(group["at"])
        meets = group["meets"].combine_chunks()
        length, keys = np.array(meets.value_lengths()), np.array(meets.flatten())
        owner, earlier = np.repeat(np.arange(len(rep)), length), keys < key
        known, column = np.unique(keys[earlier], return_inverse=True)
        before = np.zeros((len(rep), len(known)), np.float32)
        before[owner[earlier], column] = 1
        first, second = np.flatnonzero(at == i), np.flatnonzero(at == j)
        ps, qs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s in range(0, len(first), 512):
            some = first[s : s + 512]
            near = x[some] @ x[second].T >= threshold
            if near.any() and len(known):
                near &= before[some] @ before[second].T == 0
            p, q = np.nonzero(near)
            p, q = some[p], second[q]
            ok = rep[p] > rep[q] if i == j else p != q
            ps.append(p[ok])
            qs.append(q[ok])
        p, q = np.concatenate(ps), np.concatenate(qs)
        linked = np.bincount(p, n[q], len(rep)) + np.bincount(q, n[p], len(rep))
        order = np.argsort(rep, kind="stable")
        rank = np.empty(len(rep), np.int64)
        rank[order] = np.arange(len(rep))
        root = rep[order][_roots(len(rep), rank[p], rank[q])[rank]]
        some = np.flatnonzero(linked)
        return pa.table({"rep": pa.array(rep[some], pa.int64()), "root": pa.array(root[some], pa.int64()), "k": pa.array(linked[some].astype(np.int64))})

    return dealt.groupBy("dim", "key", "i", "j").applyInArrow(compare, "rep long, root long, k long")


def vector_duplicates(vectors: DataFrame, threshold: float = 0.9, **options) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector, one row for each row.

    Vectors that are null, empty or zero, or hold a null or non-finite component, and rows with a null id link with nothing
    (a null id's component is null; it is kept). Vectors of different lengths don't link. Rows are told apart by their ids; rows
    that repeat an id and a vector count as copies of each other. Extra columns, whatever their names, are not read; an empty table
    gives none back.
    """
    vectors, e = C.bounded_batches(vectors), F.col("embedding")
    scratch = C.Scratch(vectors.sparkSession)
    sound = F.col("vec_id").isNotNull() & e.isNotNull() & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    all_rows = vectors.select("vec_id", "embedding", F.coalesce(sound, F.lit(False)).alias("sound"))
    good = all_rows.filter("sound").select("vec_id", "embedding")
    rows = good.count()
    classes = scratch.keep(good.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "vectors", rows, 8_000)
    found = scratch.keep(links(classes, threshold, **options), "links", rows)
    roots = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), scratch, rows)
    partners = found.groupBy("rep").agg(F.sum("k").alias("k"))
    of_class = classes.join(partners, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left").select("embedding", "n", (F.col("n") - 1 + F.coalesce("k", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    linked = C.join_weighted(good, of_class, "embedding", "n", rows).select("vec_id", "n_links", "component_id")
    alone = all_rows.filter("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = C.materialise(linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))), "vector-groups", rows)
    scratch.drop()
    return out

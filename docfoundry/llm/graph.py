"""Connected components of links between rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch, rows: int | None = None) -> DataFrame:
    """(node, root) of every node of the links (a, b), root being the smallest node that links lead to.

    Alternates the two star operations on a table of edges until it stays as it is: every node then hangs on its root. All
    steps are joins and aggregates; a node with very many links is one row of a skewed join, which Spark splits. rows: about how many
    links there are at most.
    """
    own = Scratch(links.sparkSession)
    edges = own.keep(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi <> lo").distinct(), "edges", rows)
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == state:
            done = edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
            done = scratch.keep(done, "components", rows)
            own.drop(collect=False)
            return done
        state = now
        # large star: larger neighbours of a node move to the smallest of its neighbours and itself
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        # small star: a node and its smaller neighbours move to the smallest of these
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(root, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(root.select("hi", F.col("m").alias("lo")))
        last, own = own, Scratch(links.sparkSession)
        edges = own.keep(small.distinct(), "edges", rows)
        last.drop(collect=False)

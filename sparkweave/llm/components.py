"""Connected components by alternating large and small stars, on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def _large(edges: DataFrame) -> DataFrame:
    """Links each node's larger neighbours to the smallest of the node and its neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours to the smallest of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Returns node, root for every node of an edge between two nodes, but for the roots; root is the component's smallest node.

    Every round is written to the shared folder, so that a lost executor costs one round at most.
    """
    made: list[str] = []
    now = cut(_small(edges), "stars", made)
    mark = _mark(now)
    while True:
        now = cut(_small(_large(now)), "stars", made)
        before, mark = mark, _mark(now)
        discard(edges.sparkSession, made[:-1])
        made = made[-1:]
        if before == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))

"""Connected components of a graph given by its edges, as DataFrames: alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import heavy, join_skewed, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Ties each node's neighbours (large: the greater ones; else the lesser ones and itself) to the least of them and itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
    # in a large star, the least node of a large component is the neighbour of all others
    joined = join_skewed(both, least.drop("n"), ["a"], heavy(least, ["a"]) if large else [])
    if large:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    return joined.select("b", "m").unionByName(least.select(F.col("a").alias("b"), "m")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, component (its least node) for every node of edges (a, b); nodes without edges are not in it.

    Every round is written to the shared folder. It ends when a round changes nothing; the rounds grow as the square of the
    logarithm of the nodes, and over `most` of them is an error, not a partial result.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    check = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = check(now)
    for _ in range(most):
        if not before[0]:
            break
        now = materialize(_star(_star(now, True), False), "edges")
        after = check(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components were not found in {most} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

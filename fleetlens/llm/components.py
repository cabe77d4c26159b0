"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _state(edges: DataFrame):
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of the edges (a, b) with the smallest node it
    is connected to; nodes that are their own root are left out.

    Each round points every node's larger neighbours, then all its smaller
    ones, at the smallest; the number of rounds grows with the logarithm of
    the longest path. Nothing is gathered per node but a minimum."""
    e = (edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    e = stage(e, "edges")
    before = _state(e)
    while before[0]:
        # large star: larger neighbours of a node point at the smallest of its neighbourhood
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")).select("k", F.least("k", "m").alias("m"))
        large = (both.join(low, F.col("u") == F.col("k")).where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        large = stage(large, "large-star")
        # small star: a node and its smaller neighbours point at the smallest
        low = large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        small = (large.join(low, F.col("u") == F.col("k")).where("v <> m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct())
        e = stage(small, "small-star")
        now = _state(e)
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))

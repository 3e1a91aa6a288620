"""Connected components by alternating large-star and small-star steps, all in DataFrames.

Each step takes the smallest neighbour of a node with a map-side combined minimum and joins it
back, so a node with very many neighbours is never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

MAX_ROUNDS = 60


def _star(pairs: DataFrame, keep_larger: bool) -> DataFrame:
    """pairs (u, v): connect v with the least of u and u's neighbours."""
    low = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    met = pairs.join(low, "u")
    if keep_larger:
        return met.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = low.where(F.col("m") < F.col("u")).select("u", F.col("m").alias("v"))
    return met.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of longs in any order -> (node, component): the least node that each reaches.

    Only nodes with an edge to another node are listed.  Null ends, loops and repeated edges count for nothing.
    """
    down = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = materialise(down)
    before = None
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, True).where(F.col("u") != F.col("v")).distinct()
        small = _star(large, False).where(F.col("u") != F.col("v")).distinct()
        after = materialise(small)
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(now)
        now = after
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

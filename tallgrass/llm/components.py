"""Connected components of edge tables, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable from each node of ``edges``.

    ``edges`` (u, v) are links between long identifiers.  Each round links every
    node's larger neighbours to its smallest one, then its smaller ones to the
    smallest; the number of rounds grows with the logarithm of the longest chain.
    Edges are staged after each round; only two counts come to the driver.  The
    joins' sides are shuffled by node, and Spark splits partitions that a node
    with many links makes large.
    """
    known, mark = staged(_pairs(edges), "edges"), None
    for _ in range(max_rounds):
        both = known.union(known.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(small, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        known = staged(linked.where("u > v").distinct(), "edges")
        now = known.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    return known.select(F.col("u").alias("node"), F.col("v").alias("component")).union(known.select("v", "v").distinct())


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()

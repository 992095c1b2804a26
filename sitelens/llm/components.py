"""Connected components of an edge table, in rounds of grouped minima.

Each round connects every node's larger neighbours to its smallest neighbour
(large star) and then its smaller neighbours to the smallest of them (small
star); edges turn into stars around each component's smallest node in about
log(n) rounds.  Minima are pre-aggregated, so a node with very many neighbours
costs one row per task; each round's edges are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("big", "small").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, root: the smallest node reachable, for every node that has an edge (roots too)."""
    now = stored(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("big"), F.least(a, b).alias("small")).distinct(), "edges")
    state = _state(now)
    while True:
        both = now.select("big", "small").unionAll(now.select(F.col("small").alias("big"), F.col("big").alias("small")))
        least = both.groupBy(F.col("big").alias("node")).agg(F.min("small").alias("low")).select("node", F.least("node", "low").alias("low"))
        # below, `big` is the node and `small` its neighbour
        large = (both.where("small > big").join(least, F.col("big") == F.col("node"))
                 .select(F.col("small").alias("big"), F.col("low").alias("small")).distinct())
        # a node's own smallest neighbour stays linked to it even where that node has no larger neighbour
        low = large.groupBy(F.col("big").alias("node")).agg(F.min("small").alias("low"))
        small = (large.join(low, F.col("big") == F.col("node")).where("small != low")
                 .select(F.col("small").alias("big"), F.col("low").alias("small")))
        after = stored(small.unionAll(low.select(F.col("node").alias("big"), F.col("low").alias("small"))).distinct(), "edges")
        new = _state(after)
        if new == state:
            break
        now, state = after, new
    return now.select(F.col("big").alias("node"), F.col("small").alias("root")).unionAll(
        now.select(F.col("small").alias("node"), F.col("small").alias("root")).distinct())

"""Connected components of an undirected graph by alternating large-star and small-star rounds.

Every round is a partial aggregate and a join on the node, so a node with very many neighbours is
combined before the shuffle; the smallest neighbours are a written table, so that the join shuffles
both sides and adaptive execution can split such a node's edges. The number of rounds grows
with the logarithm of the longest path. Each round's edges are a written table, too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import discard, stage


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The new edges, and a written table that they read."""
    near = _both(edges)
    low = stage(near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "hubs")
    return near.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), low


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v")
    low = stage(down.groupBy("u").agg(F.min("v").alias("m")), "hubs")
    joined = down.join(low, "u")
    return joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))), low


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): for every node of a link, the smallest node that it reaches. Links that
    repeat, run both ways or join a node with itself do no harm; those with a null end are ignored."""
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v")
    edges = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        large, hubs = _large_star(edges)
        small, lower = _small_star(large)
        # What the round leaves is told by the job that writes it.
        told = Observation()
        marked = small.where("u != v").distinct().observe(told, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"))
        before, edges = edges, stage(marked, "edges")
        discard(before, hubs, lower)
        if seen == told.get:
            break
        seen = told.get
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)

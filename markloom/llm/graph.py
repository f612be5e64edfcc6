"""Connected components of a graph given by its edges, by alternating large and small stars.

Each round links every node's larger neighbours to its smallest neighbour (large star), then every node's smaller
neighbours to the smallest (small star). The number of rounds is logarithmic, long chains included; no round holds the
neighbours of a node in one task: minima are combined before the exchange and joined back, and a node with very many
neighbours is a skewed join, which adaptive execution splits. Only the count of changes reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, settle


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation over edges (a, b) with a > b."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    low = both.groupBy("a").agg(F.min("b").alias("_low")).withColumn("_low", F.least("a", "_low"))
    if large:
        # every neighbour above a goes to the smallest of a and its neighbours; it was linked to a itself before
        out = edges.select(F.col("b").alias("a"), F.col("a").alias("_up")).join(low, "a").select(F.col("_up").alias("a"), F.col("_low").alias("b"))
    else:
        joined = edges.join(low, "a")
        out = joined.select(F.when(F.col("b") == F.col("_low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("_low").alias("b"))
    return out.filter(F.col("a") > F.col("b")).distinct()


def components(edges: DataFrame, most_rounds: int = 60, tables: Tables | None = None) -> DataFrame:
    """(node, component) for every node of the edges (a, b); the component is its smallest node.

    Loops and repeated edges are allowed; no edges give no rows. Nulls must not occur. Rounds are settled in `tables`, which
    the result reads; without, by checkpoints.
    """
    put = tables.settle if tables else settle
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    now = put(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(most_rounds):
        now = put(_star(_star(now, large=True), large=False))
        # Stars are final when the edges no longer change: their number and a sum of hashes tell.
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("_root")), "node", "left").select("node", F.coalesce("_root", "node").alias("component"))

"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _settled(state: DataFrame) -> bool:
    """Whether every node has one parent and no parent has a parent."""
    nodes = state.groupBy("u").agg(F.min("v").alias("v"), F.max("v").alias("other"))
    parents = state.select(F.col("v").alias("u"), F.lit(True).alias("parent")).distinct()
    return nodes.join(parents, "u", "left").where("v <> other or parent").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge; ``edges``: (u, v) longs. The root is the smallest node reachable.

    Every round is written to the shared checkpoint folder; a round's edges never outnumber the first.
    """
    state = checkpointed(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _settled(state):
        state = checkpointed(_small(_large(state)))
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)

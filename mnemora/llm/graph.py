"""Connected components by alternating star contractions, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.llm.common import saved


def _directed(edges: DataFrame) -> DataFrame:
    """Edges from the larger to the smaller end, without loops and repeats."""
    return (
        edges.where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the smallest node around it."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each smaller neighbour of a node, and the node, to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
        joined.select("u", F.col("m").alias("v"))
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of an edge (u, v); a component is named by its smallest node.

    Minima are aggregated before the shuffle and hubs meet their edges in joins that AQE may
    split, so a node with very many edges is no hot task. Each turn is written to the shared
    folder. Empty edges give an empty result.
    """
    now, state = saved(_directed(edges), "edges"), None
    while True:
        after = saved(_directed(_small_star(_directed(_large_star(now)))), "edges")
        found = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        # Equal sums can come from different edges: only equal edges end it.
        if tuple(found) == state and after.join(now, ["u", "v"], "left_anti").isEmpty():
            break
        now, state = after, tuple(found)
    leaves = after.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = after.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return leaves.union(roots).distinct()

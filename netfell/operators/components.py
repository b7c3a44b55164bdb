"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netfell.scratch import Scratch


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Tie each node's larger neighbours to the least of the node and its neighbours."""
    both = _both(edges)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Tie each node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    others = down.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def component_labels(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """node and the least node of its component, for every node that has an edge (u, v).

    Alternating stars (large, then small) until nothing changes: the number of rounds grows with the logarithm of the
    longest path, no neighbour list is ever gathered, and each round's edges are a written table, so that the lineage
    stays short and a lost executor costs one round at most.
    """
    now = scratch.write(edges.select("u", "v").where("u <> v").distinct(), f"{name}-0")
    mark = _mark(now)
    for i in range(1, 1000):
        after = scratch.write(_small_star(_large_star(now)), f"{name}-{i}")
        scratch.drop(f"{name}-{i - 1}")
        before, mark, now = mark, _mark(after), after
        if mark == before:
            break
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots.select("node", F.col("node").alias("component")))


def _mark(edges: DataFrame) -> tuple:
    """Two edge sets with the same mark are the same but for a chance of 2**-64."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

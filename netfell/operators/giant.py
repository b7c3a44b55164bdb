"""The highest weight threshold that keeps a giant component together."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netfell.functions.expressions import binarised, linspace, rounded
from netfell.operators.graph import density, weight_range
from netfell.tables import reachable


def _sizes(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Descending weights at which the largest component grows, and its size with all edges of at least that weight."""
    parent, size, top = list(range(n)), [1] * n, 1 if n else 0
    weights, largest = [], []
    for i in np.argsort(-w, kind="stable").tolist():
        a, b = int(u[i]), int(v[i])
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        while parent[b] != b:
            parent[b] = parent[parent[b]]
            b = parent[b]
        if a != b:
            if size[a] < size[b]:
                a, b = b, a
            parent[b] = a
            size[a] += size[b]
            if size[a] > top:
                top = size[a]
                weights.append(w[i])
                largest.append(top)
    return np.array(weights), np.array(largest, np.int64)


def sweep(edges: DataFrame, nodes: DataFrame, steps: int = 1000) -> DataFrame:
    """graph_id, i, threshold and gcc: the largest component's size among edges above each of ``steps`` even thresholds
    from the least to the largest cell of the dense matrix.

    One pass over a graph's edges by falling weight gives the size at every threshold, as edges only join components."""
    reachable(nodes.sparkSession)
    grid = weight_range(edges, nodes).select("graph_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: linspace(F.col("low"), F.col("high"), i, steps))).alias("i", "threshold"))
    ends = nodes.groupBy("graph_id").agg(F.sort_array(F.collect_list("node")).alias("ids"))
    both = grid.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("i", "threshold"))).alias("grid")).join(ends, "graph_id")

    def run(own: pa.Table, own_edges: pa.Table) -> pa.Table:
        row = own.to_pylist()[0]
        ids = np.array(row["ids"], np.int64)
        u, v = (np.searchsorted(ids, own_edges.column(c).to_numpy()) for c in ("u", "v"))
        weights, largest = _sizes(len(ids), u, v, own_edges.column("w").to_numpy())
        t = np.array([g["threshold"] for g in row["grid"]])
        above = np.searchsorted(-weights, -t, side="left")
        gcc = np.concatenate([[1], largest])[above]
        return pa.table({"graph_id": pa.array([row["graph_id"]] * len(t)), "i": pa.array([g["i"] for g in row["grid"]], pa.int32()), "threshold": pa.array(t), "gcc": pa.array(gcc, pa.int64())})

    return both.groupBy("graph_id").cogroup(edges.select("graph_id", "u", "v", "w").groupBy("graph_id")).applyInArrow(run, "graph_id string, i int, threshold double, gcc long")


def giant_threshold(edges: DataFrame, nodes: DataFrame, fraction: float = 0.75, steps: int = 1000) -> DataFrame:
    """graph_id, target, i, threshold and gcc at the last threshold whose largest component reaches round(fraction * N)."""
    target = nodes.groupBy("graph_id").agg(F.greatest(F.lit(1), rounded(F.lit(fraction) * F.count("*"), "half_even")).alias("target"))
    good = sweep(edges, nodes, steps).join(F.broadcast(target), "graph_id").where("gcc >= target")
    return good.groupBy("graph_id", "target").agg(F.max_by(F.struct("i", "threshold", "gcc"), "i").alias("b")).select("graph_id", "target", "b.*")


def giant_graph(edges: DataFrame, nodes: DataFrame, fraction: float = 0.75, steps: int = 1000) -> tuple[DataFrame, DataFrame]:
    """The binary graph above that threshold, and the threshold with the graph's density."""
    found = giant_threshold(edges, nodes, fraction, steps)
    above = edges.join(F.broadcast(found.select("graph_id", "threshold")), "graph_id").withColumn("w", binarised(F.col("w"), F.col("threshold"))).where("w > 0").drop("threshold")
    return above, found.join(density(above, nodes), "graph_id")

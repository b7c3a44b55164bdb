"""Classical hub metrics: degree, betweenness and PageRank."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netfell.operators.clustering import MOST_NODES
from netfell.operators.graph import both_ways, lengths, strengths
from netfell.tables import reachable


def _brandes(n: int, near: list[list[tuple[int, float]]]) -> np.ndarray:
    """Betweenness over all ordered pairs, path lengths summed in order of increasing distance."""
    out = np.zeros(n)
    for s in range(n):
        dist, paths, before = [np.inf] * n, [0.0] * n, [[] for _ in range(n)]
        dist[s], paths[s] = 0.0, 1.0
        heap, order, done = [(0.0, s)], [], [False] * n
        while heap:
            d, x = heapq.heappop(heap)
            if done[x]:
                continue
            done[x] = True
            order.append(x)
            for y, w in near[x]:
                new = d + w
                if done[y] and new >= dist[y]:
                    continue
                if new < dist[y] * (1 - 1e-12):
                    dist[y], paths[y], before[y] = new, paths[x], [x]
                    heapq.heappush(heap, (new, y))
                elif new <= dist[y] * (1 + 1e-12):
                    paths[y] += paths[x]
                    before[y].append(x)
        part = [0.0] * n
        for x in reversed(order):
            for p in before[x]:
                part[p] += paths[p] / paths[x] * (1 + part[x])
            if x != s:
                out[x] += part[x]
    return out


def betweenness(edges: DataFrame, nodes: DataFrame, weighted: bool = False) -> DataFrame:
    """graph_id, node and value: shortest paths through a node, unnormalised, each ordered pair counted; weights become
    lengths 1 / w. A graph is one group, refused above MOST_NODES nodes."""
    reachable(nodes.sparkSession)
    used = lengths(edges) if weighted else edges.where("w <> 0").withColumn("w", F.lit(1.0))

    def run(own_nodes: pa.Table, own_edges: pa.Table) -> pa.Table:
        ids = np.sort(own_nodes.column("node").to_numpy())
        if len(ids) > MOST_NODES:
            raise ValueError(f"a graph of {len(ids)} nodes; at most {MOST_NODES} are handled in one task")
        near: list[list[tuple[int, float]]] = [[] for _ in ids]
        ends = [np.searchsorted(ids, own_edges.column(c).to_numpy()).tolist() for c in ("u", "v")]
        for a, b, w in zip(*ends, own_edges.column("w").to_pylist(), strict=True):
            near[a].append((b, w))
            near[b].append((a, w))
        graph = own_nodes.column("graph_id")[0].as_py() if len(ids) else ""
        return pa.table({"graph_id": pa.array([graph] * len(ids)), "node": pa.array(ids.astype(np.int32)), "value": pa.array(_brandes(len(ids), near))})

    return nodes.select("graph_id", "node").groupBy("graph_id").cogroup(used.select("graph_id", "u", "v", "w").groupBy("graph_id")).applyInArrow(run, "graph_id string, node int, value double")


def pagerank(edges: DataFrame, nodes: DataFrame, damping: float = 0.85, rounds: int = 150, scratch=None) -> DataFrame:
    """graph_id, node and value: the fixed point of (1 - d) / N + d * sum of neighbours' value * w / strength, a node
    without edges passing nothing on, scaled to sum 1. ``rounds`` bounds the error by damping ** rounds; with scratch,
    every ten rounds are written, so that the plan stays short."""
    size = nodes.groupBy("graph_id").agg(F.count("*").alias("n"))
    flow = both_ways(edges).join(strengths(edges, nodes).select("graph_id", F.col("node").alias("u"), "strength"), ["graph_id", "u"])
    flow = flow.where("strength <> 0").select("graph_id", "u", F.col("v").alias("node"), (F.col("w") / F.col("strength")).alias("share"))
    base = nodes.select("graph_id", "node").join(F.broadcast(size), "graph_id").select("graph_id", "node", ((1 - damping) / F.col("n")).alias("base"))
    now = base.select("graph_id", "node", F.col("base").alias("value"))
    if scratch is not None:
        flow, base = scratch.write(flow, "pagerank-flow"), scratch.write(base, "pagerank-base")
    for i in range(rounds):
        got = flow.join(now.withColumnRenamed("node", "u"), ["graph_id", "u"]).groupBy("graph_id", "node").agg(F.sum(F.col("value") * F.col("share")).alias("got"))
        now = base.join(got, ["graph_id", "node"], "left").select("graph_id", "node", (F.col("base") + damping * F.coalesce("got", F.lit(0.0))).alias("value"))
        if scratch is not None and i % 10 == 9:
            now = scratch.write(now, f"pagerank-{i}")
            scratch.drop(f"pagerank-{i - 10}")
    total = now.groupBy("graph_id").agg(F.sum("value").alias("total"))
    return now.join(F.broadcast(total), "graph_id").select("graph_id", "node", (F.col("value") / F.col("total")).alias("value"))


def pagerank_solved(edges: DataFrame, nodes: DataFrame, damping: float = 0.85) -> DataFrame:
    """The same by one linear solve per graph, for graphs up to MOST_NODES nodes."""
    reachable(nodes.sparkSession)

    def run(own_nodes: pa.Table, own_edges: pa.Table) -> pa.Table:
        ids = np.sort(own_nodes.column("node").to_numpy())
        n = len(ids)
        if n > MOST_NODES:
            raise ValueError(f"a graph of {n} nodes; at most {MOST_NODES} are handled in one task")
        a = np.zeros((n, n))
        u, v = (np.searchsorted(ids, own_edges.column(c).to_numpy()) for c in ("u", "v"))
        np.add.at(a, (u, v), own_edges.column("w").to_numpy())
        a = a + a.T
        degree = a.sum(axis=0)
        degree[degree == 0] = 1
        r = np.linalg.solve(np.eye(n) - damping * (a / degree), np.full(n, (1 - damping) / max(n, 1)))
        graph = own_nodes.column("graph_id")[0].as_py() if n else ""
        return pa.table({"graph_id": pa.array([graph] * n), "node": pa.array(ids.astype(np.int32)), "value": pa.array(r / r.sum())})

    return nodes.select("graph_id", "node").groupBy("graph_id").cogroup(edges.select("graph_id", "u", "v", "w").groupBy("graph_id")).applyInArrow(run, "graph_id string, node int, value double")

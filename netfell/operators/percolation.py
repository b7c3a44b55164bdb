"""Random removal of all nodes of a graph, step by step, many times over.

One attack removes the nodes in a random order. Which components are left after a step hangs on the survivors alone, so
the nodes are put back in reverse order into a union-find structure that tracks the two largest sizes: near linear in
edges, where removal step by step is quadratic. Attacks are independent and run as rows of a DataFrame; the adjacency,
whose size is checked, goes to every executor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netfell.tables import reachable

#: Most edges and nodes, over all graphs, that are sent to every executor.
MOST_EDGES = 20_000_000
#: Attacks handed to a task at a time.
ATTACK_BLOCK = 256


class Adjacency:
    """Neighbour lists of several graphs as flat arrays, sent to executors once."""

    def __init__(self, edges: DataFrame, nodes: DataFrame):
        size = edges.count() + nodes.count()
        if size > MOST_EDGES:
            raise ValueError(f"{size} edges and nodes; at most {MOST_EDGES} are sent to executors")
        named = nodes.select("graph_id", "node").toPandas()
        ends = edges.where("w <> 0 AND u <> v").select("graph_id", "u", "v").toPandas()
        self.graphs: dict[str, tuple[np.ndarray, list[list[int]]]] = {}
        by_graph = dict(tuple(ends.groupby("graph_id")))
        for graph, own in named.groupby("graph_id"):
            ids = np.sort(own["node"].to_numpy())
            near: list[list[int]] = [[] for _ in ids]
            if graph in by_graph:
                for a, b in zip(*(np.searchsorted(ids, by_graph[graph][c].to_numpy()).tolist() for c in "uv"), strict=True):
                    near[a].append(b)
                    near[b].append(a)
            self.graphs[graph] = (ids, near)


def removal_order(ids: np.ndarray, seed: int, attack: int, rule: str) -> np.ndarray:
    """Places in ``ids`` in the order of removal. ``md5`` is the order of md5(seed:attack:node), which any SQL engine can
    repeat; ``philox`` a counter-based generator keyed by seed and attack. Both are the same on every executor and retry."""
    if rule == "philox":
        return np.random.Generator(np.random.Philox(key=[seed, attack])).permutation(len(ids))
    keys = [(hashlib.md5(f"{seed}:{attack}:{n}".encode()).hexdigest(), n) for n in ids.tolist()]
    return np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)


def two_sizes(order: list[int], near: list[list[int]]) -> tuple[list[int], list[int]]:
    """Largest and second-largest component after each number of removals 0, 1, ..., n."""
    n = len(order)
    parent, size, held = list(range(n)), [0] * n, [0] * (n + 2)
    first = second = 0
    firsts, seconds = [0] * (n + 1), [0] * (n + 1)
    for step in range(n - 1, -1, -1):
        x = order[step]
        total, roots = 1, []
        for y in near[x]:
            if size[y]:
                while parent[y] != y:
                    parent[y] = parent[parent[y]]
                    y = parent[y]
                if y not in roots:
                    roots.append(y)
        big = x
        for y in roots:
            total += size[y]
            held[size[y]] -= 1
            if big == x or size[y] > size[big]:
                big = y
        size[x] = 1
        for y in roots:
            parent[y] = big
        parent[x] = big
        size[big] = total
        held[total] += 1
        if total >= first:
            if held[first] if total > first else held[first] > 1:  # the old largest is still there
                second = first
            first = total
        elif total > second:
            second = total
        if second == first and held[first] < 2:
            second -= 1
        while second > 0 and not held[second]:
            second -= 1
        firsts[step], seconds[step] = first, second
    return firsts, seconds


def percolation_step(seconds: list[int]) -> int:
    """The first of steps 1 to n - 1 where the second size is largest, or n if it is never above 1."""
    n = len(seconds) - 1
    inner = seconds[1:n]
    top = max(inner, default=0)
    return inner.index(top) + 1 if top > 1 else n


def _attacks(nodes: DataFrame, first: int, n: int) -> DataFrame:
    """graph_id and attack blocks [start, stop), spread over the cluster."""
    spark = nodes.sparkSession
    reachable(spark)
    starts = spark.range(first // ATTACK_BLOCK, -(-(first + n) // ATTACK_BLOCK)).select(
        F.greatest(F.col("id") * ATTACK_BLOCK, F.lit(first)).alias("start"), F.least((F.col("id") + 1) * ATTACK_BLOCK, F.lit(first + n)).alias("stop")
    )
    blocks = nodes.select("graph_id").distinct().crossJoin(F.broadcast(starts))  # a row for each graph and block
    return blocks.repartition(max(spark.sparkContext.defaultParallelism, 1) * 2, "graph_id", "start")


def attack_positions(nodes: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """graph_id, attack_id, node and pos (from 1) under the md5 order, in DataFrame functions."""
    from pyspark.sql import Window

    attacks = nodes.sparkSession.range(n).select(F.col("id").alias("attack_id"))
    rows = nodes.select("graph_id", "node").crossJoin(F.broadcast(attacks))
    key = F.md5(F.concat_ws(":", F.lit(seed), "attack_id", "node"))
    place = F.row_number().over(Window.partitionBy("graph_id", "attack_id").orderBy(key, "node"))
    return rows.select("graph_id", "attack_id", "node", place.cast("int").alias("pos"))


def trace(edges: DataFrame, nodes: DataFrame, n: int, seed: int = 1, rule: str = "md5", first: int = 0) -> DataFrame:
    """graph_id, attack_id, step (1 to N - 1), first and second size after that many removals."""
    shared = nodes.sparkSession.sparkContext.broadcast(Adjacency(edges, nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for graph, start, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, near = shared.value.graphs[graph]
                m = len(ids) - 1
                for attack in range(start, stop):
                    a, b = two_sizes(removal_order(ids, seed, attack, rule).tolist(), near)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([graph] * m), pa.array([attack] * m, pa.int64()), pa.array(range(1, m + 1), pa.int32()), pa.array(a[1 : m + 1], pa.int32()), pa.array(b[1 : m + 1], pa.int32())],
                        ["graph_id", "attack_id", "step", "first", "second"],
                    )

    return _attacks(nodes, first, n).mapInArrow(run, "graph_id string, attack_id long, step int, first int, second int")


def percolation_points(edges: DataFrame, nodes: DataFrame, n: int, seed: int = 1, rule: str = "md5", first: int = 0) -> DataFrame:
    """graph_id, attack_id and pstep of each attack."""
    shared = nodes.sparkSession.sparkContext.broadcast(Adjacency(edges, nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for graph, start, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, near = shared.value.graphs[graph]
                steps = [percolation_step(two_sizes(removal_order(ids, seed, i, rule).tolist(), near)[1]) for i in range(start, stop)]
                yield pa.RecordBatch.from_arrays([pa.array([graph] * len(steps)), pa.array(range(start, stop), pa.int64()), pa.array(steps, pa.int32())], ["graph_id", "attack_id", "pstep"])

    return _attacks(nodes, first, n).mapInArrow(run, "graph_id string, attack_id long, pstep int")


def hits(edges: DataFrame, nodes: DataFrame, n: int, seed: int = 1, rule: str = "md5", first: int = 0, chunk: int | None = None) -> DataFrame:
    """graph_id, chunk, step, node and k: in how many attacks with that percolation step the node was among the removed.

    Each block of attacks is summed before it leaves the task; chunk is attack_id / chunk, or 0."""
    shared = nodes.sparkSession.sparkContext.broadcast(Adjacency(edges, nodes))
    per = chunk or (1 << 62)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for graph, start, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, near = shared.value.graphs[graph]
                while start < stop:
                    end = min(stop, (start // per + 1) * per)
                    found: dict[int, np.ndarray] = {}
                    for i in range(start, end):
                        order = removal_order(ids, seed, i, rule)
                        step = percolation_step(two_sizes(order.tolist(), near)[1])
                        found.setdefault(step, np.zeros(len(ids), np.int64))[order[:step]] += 1
                    for step, k in sorted(found.items()):
                        at = np.flatnonzero(k)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([graph] * len(at)), pa.array([start // per] * len(at), pa.int64()), pa.array([step] * len(at), pa.int32()), pa.array(ids[at].astype(np.int32)), pa.array(k[at])],
                            ["graph_id", "chunk", "step", "node", "k"],
                        )
                    start = end

    rows = _attacks(nodes, first, n).mapInArrow(run, "graph_id string, chunk long, step int, node int, k long")
    return rows.groupBy("graph_id", "chunk", "step", "node").agg(F.sum("k").alias("k"))


def step_counts(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """graph_id, step (1 to N) and n: attacks that percolate there, 0 included."""
    steps = nodes.groupBy("graph_id").agg(F.count("*").cast("int").alias("m")).select("graph_id", F.explode(F.sequence(F.lit(1), F.col("m"))).alias("step"))
    seen = points.groupBy("graph_id", F.col("pstep").alias("step")).agg(F.count("*").alias("n"))
    return steps.join(seen, ["graph_id", "step"], "left").fillna({"n": 0})


def counts_from_hits(hit: DataFrame) -> DataFrame:
    """graph_id, step and n from summed hits: every attack with step s hits s nodes, so n is the hits over s."""
    return hit.groupBy("graph_id", "step").agg((F.sum("k") / F.col("step")).cast("long").alias("n"))


def participation(hit: DataFrame, nodes: DataFrame) -> DataFrame:
    """graph_id, step, node, n, k and p = k / n for every step 1 to N and every node; p is NULL where n is 0."""
    hit = hit.groupBy("graph_id", "step", "node").agg(F.sum("k").alias("k"))
    steps = nodes.groupBy("graph_id").agg(F.count("*").cast("int").alias("m")).select("graph_id", F.explode(F.sequence(F.lit(1), F.col("m"))).alias("step"))
    cells = steps.join(counts_from_hits(hit), ["graph_id", "step"], "left").join(nodes.select("graph_id", "node"), "graph_id")
    full = cells.join(hit, ["graph_id", "step", "node"], "left").fillna({"n": 0, "k": 0})
    return full.select("graph_id", "step", "node", "n", "k", (F.col("k") / F.nullif("n", F.lit(0))).alias("p"))

"""Ward clustering of node profiles, silhouettes, and the critical nodes they give.

Linkage needs all of a graph's vectors at once, so a graph is one group of applyInArrow; graphs run side by side. A
graph with more nodes than MOST_NODES is refused rather than half done. Silhouettes of given labels need only pairs, so
they are summed block by block and refuse nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netfell.operators import profiles
from netfell.tables import reachable

#: Nodes of a graph up to which the distances of all pairs are held by one task (200 MB at 5000).
MOST_NODES = 5000
#: Vectors of a block whose distances to another block's are held by one task (32 MB at 2000).
BLOCK_ROWS = 2000


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    node = table.column("node").to_numpy()
    order = np.argsort(node, kind="stable")
    if len(node) > MOST_NODES:
        raise ValueError(f"a graph of {len(node)} nodes; at most {MOST_NODES} are clustered in one task")
    x = np.array(table.column("x").to_pylist(), float)
    return node[order], x.reshape(len(node), -1)[order]


def distances(x: np.ndarray) -> np.ndarray:
    """Euclidean distance of all pairs."""
    square = (x * x).sum(axis=1)
    out = np.sqrt(np.maximum(square[:, None] + square[None] - 2 * x @ x.T, 0))
    np.fill_diagonal(out, 0)
    exact = np.argwhere(np.triu(out < 1e-6 * (1 + np.sqrt(square.max(initial=0))), 1))
    for i, j in exact:  # close pairs lose digits above
        out[i, j] = out[j, i] = np.sqrt(((x[i] - x[j]) ** 2).sum())
    return out


def ward(x: np.ndarray) -> list[tuple[int, int, float, int]]:
    """Merges (left, right, height, size) in order of height. Leaves are 0 to n - 1, merge i makes n + i. By the chain of
    nearest neighbours: n ** 2 steps, as Ward's criterion never makes two clusters' union nearer to a third."""
    n = len(x)
    d = distances(x) ** 2
    np.fill_diagonal(d, np.inf)
    size, alive, chain, found = np.ones(n), np.ones(n, bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            a = chain[-1]
            row = np.where(alive, d[a], np.inf)
            b = int(row.argmin())
            if len(chain) > 1 and row[chain[-2]] <= row[b]:
                b = chain[-2]
                break
            chain.append(b)
        chain = chain[:-2]
        found.append((a, b, float(np.sqrt(d[a, b]))))
        na, nb = size[a], size[b]
        new = ((na + size) * d[a] + (nb + size) * d[b] - size * d[a, b]) / (na + nb + size)
        alive[a] = False
        d[b], d[:, b] = new, new
        d[b, b] = np.inf
        size[b] = na + nb
    found.sort(key=lambda m: m[2])
    name, out = list(range(n)), []
    up = list(range(n))

    def root(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    total = [1] * n
    for i, (a, b, h) in enumerate(found):
        a, b = root(a), root(b)
        left, right = sorted((name[a], name[b]))
        up[a], total[b], name[b] = b, total[a] + total[b], n + i
        out.append((left, right, h, total[b]))
    return out


def cut(merges: list[tuple[int, int, float, int]], n: int, k: int) -> np.ndarray:
    """Cluster of each leaf when the tree is cut into at most k clusters. Merges of equal height are done together, so
    there may be fewer. Labels count from 1 in the order of the clusters' least leaves."""
    must = max(0, n - k)
    limit = merges[must - 1][2] if must else -1.0
    label = [0] * n
    of: dict[int, list[int]] = {i: [i] for i in range(n)}
    for i, (a, b, height, _) in enumerate(merges):
        if height > limit:
            break
        of[n + i] = of.pop(a) + of.pop(b)
    for j, own in enumerate(sorted(of.values(), key=min)):
        for leaf in own:
            label[leaf] = j + 1
    return np.array(label)


def silhouettes(d: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Each point's silhouette. Alone in its cluster its own distance is 0; equal distances of 0 give 0, and so does a
    single cluster."""
    kinds, at = np.unique(labels, return_inverse=True)
    if len(kinds) < 2:
        return np.zeros(len(labels))
    count = np.bincount(at)
    sums = np.stack([d[:, at == j].sum(axis=1) for j in range(len(kinds))], axis=1)
    mine = np.arange(len(labels))
    a = sums[mine, at] / np.maximum(count[at] - 1, 1)
    others = sums / count
    others[mine, at] = np.inf
    b = others.min(axis=1)
    top = np.maximum(a, b)
    return np.where(top > 0, (b - a) / np.where(top > 0, top, 1), 0.0)


def best_k(x: np.ndarray, k_min: int = 2, k_max: int = 10) -> tuple[int, np.ndarray, list[tuple[int, float]]]:
    """The number of clusters with the largest mean silhouette (the smallest of equals), its labels, and all scores."""
    n = len(x)
    if n <= k_min:
        return 1, np.ones(n, int), []
    merges, d, scores, best = ward(x), distances(x), [], (-np.inf, 1, np.ones(n, int))
    for k in range(k_min, min(k_max, n - 1) + 1):
        labels = cut(merges, n, k)
        score = float(silhouettes(d, labels).mean())
        scores.append((k, score))
        if score > best[0] + 1e-12:
            best = (score, k, labels)
    return best[1], best[2], scores


def _grouped(vectors: DataFrame, run, schema: str) -> DataFrame:
    reachable(vectors.sparkSession)
    return vectors.select("graph_id", "node", "x").groupBy("graph_id").applyInArrow(run, schema)


def linkage(vectors: DataFrame) -> DataFrame:
    """graph_id, i, left, right, height and size of every merge, from vectors(graph_id, node, x)."""

    def run(table: pa.Table) -> pa.Table:
        _, x = _matrix(table)
        rows = ward(x)
        left, right, height, size = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.table({"graph_id": pa.array([table.column("graph_id")[0].as_py()] * len(rows), pa.string()), "i": pa.array(range(len(rows)), pa.int32()), "left": pa.array(left, pa.int32()), "right": pa.array(right, pa.int32()), "height": pa.array(height, pa.float64()), "size": pa.array(size, pa.int32())})

    return _grouped(vectors, run, "graph_id string, i int, left int, right int, height double, size int")


def clusters(vectors: DataFrame, k: int) -> DataFrame:
    """graph_id, node and label when each graph is cut into at most k clusters."""

    def run(table: pa.Table) -> pa.Table:
        node, x = _matrix(table)
        return _labelled(table, node, cut(ward(x), len(x), k))

    return _grouped(vectors, run, "graph_id string, node int, label int")


def optimal_clusters(vectors: DataFrame, k_min: int = 2, k_max: int = 10) -> DataFrame:
    """graph_id, node, label and k for the k that ``best_k`` picks."""

    def run(table: pa.Table) -> pa.Table:
        node, x = _matrix(table)
        k, labels, _ = best_k(x, k_min, k_max)
        return _labelled(table, node, labels).append_column("k", pa.array([k] * len(node), pa.int32()))

    return _grouped(vectors, run, "graph_id string, node int, label int, k int")


def _labelled(table: pa.Table, node: np.ndarray, labels: np.ndarray) -> pa.Table:
    return pa.table({"graph_id": pa.array([table.column("graph_id")[0].as_py()] * len(node), pa.string()), "node": pa.array(node.astype(np.int32)), "label": pa.array(labels.astype(np.int32))})


def _between(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distance of every row of x to every row of y."""
    p, q = (x * x).sum(axis=1), (y * y).sum(axis=1)
    out = np.sqrt(np.maximum(p[:, None] + q[None] - 2 * x @ y.T, 0))
    close = out < 1e-6 * (1 + np.sqrt(max(p.max(initial=0), q.max(initial=0))))
    for i in np.flatnonzero(close.any(axis=1)):  # close pairs lose digits above
        out[i, close[i]] = np.sqrt(((x[i] - y[close[i]]) ** 2).sum(axis=1))
    return out


def silhouette(vectors: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """graph_id and mean silhouette of vectors(graph_id, node, x, label), of any number of vectors: a task has two
    blocks of about ``rows`` vectors, and sums each point's distances to the other block's points by their label."""
    reachable(vectors.sparkSession)
    points = vectors.groupBy("graph_id", "node", "x", "label").agg(F.count("*").alias("copies")).withColumn("h", F.xxhash64("x", "label"))
    blocks = vectors.groupBy(F.col("graph_id").alias("g")).agg(F.ceil(F.count("*") / rows).alias("blocks"))
    points = points.join(F.broadcast(blocks), F.col("graph_id").eqNullSafe(F.col("g"))).withColumn("block", F.pmod(F.xxhash64("node", "h"), "blocks"))
    columns = ["graph_id", "a", "b", "node", "h", "label", "copies", "x"]
    left = points.withColumn("a", F.col("block")).withColumn("b", F.explode(F.sequence("block", F.col("blocks") - 1))).select(columns)
    right = points.withColumn("b", F.col("block")).withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), "block"))).select(*(F.col(c).alias(f"r_{c}") for c in columns))
    names = ["graph_id", "node", "h", "label", "copies", "other", "n", "s"]

    def summed(own: pa.Table, others: pa.Table, d: np.ndarray) -> pa.Table:
        kinds = others.column("label").combine_chunks().dictionary_encode(null_encoding="encode")
        copies, k, n = others.column("copies").to_numpy(), len(kinds.dictionary), own.num_rows
        of = np.zeros((len(copies), k))
        of[np.arange(len(copies)), kinds.indices.to_numpy()] = copies
        each = own.select(["graph_id", "node", "h", "label", "copies"]).take(np.repeat(np.arange(n), k))
        other = kinds.dictionary.take(pa.array(np.tile(np.arange(k), n)))
        return pa.table([*each.columns, other, pa.array(np.tile(of.sum(axis=0).astype(np.int64), n)), pa.array((d @ of).reshape(-1))], names=names)

    def run(key: tuple, own: pa.Table, others: pa.Table) -> pa.Table:
        others = others.rename_columns(columns)
        x, y = (np.array(t.column("x").to_pylist(), float).reshape(t.num_rows, -1) for t in (own, others))
        if not len(x) or not len(y):
            return summed(own, others, np.zeros((len(x), len(y))))
        d = _between(x, y)
        there = summed(own, others, d)
        return there if key[1].as_py() == key[2].as_py() else pa.concat_tables([there, summed(others, own, d.T)])

    kind = dict(points.dtypes)
    schema = ", ".join(f"{c} {kind[{'other': 'label'}.get(c, c)]}" for c in names[:6]) + ", n long, s double"
    keys = ["graph_id", "a", "b"]
    sums = left.groupBy(keys).cogroup(right.groupBy([f"r_{c}" for c in keys])).applyInArrow(run, schema)
    point = names[:5]
    by_label = sums.groupBy(*point, "other").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    inside = F.col("other").eqNullSafe(F.col("label"))
    a, b = F.col("near"), F.col("far")
    scored = by_label.groupBy(*point).agg(F.sum(F.when(inside, F.col("s") / F.greatest(F.col("n") - 1, F.lit(1)))).alias("near"), F.min(F.when(~inside, F.col("s") / F.col("n"))).alias("far"))
    value = F.when(b.isNotNull() & (F.greatest(a, b) > 0), (b - a) / F.greatest(a, b)).otherwise(0.0)
    return scored.groupBy("graph_id").agg((F.sum(value * F.col("copies")) / F.sum("copies")).alias("silhouette"))


def cluster_stats(labelled: DataFrame) -> DataFrame:
    """graph_id, label, size, mean and sd of labelled(graph_id, node, label, total), and z: how far the mean is above
    that of the lowest cluster, in the latter's sd (as it is where that is 0)."""
    stats = labelled.groupBy("graph_id", "label").agg(F.count("*").alias("size"), F.avg("total").alias("mean"), F.stddev_pop("total").alias("sd"))
    base = stats.groupBy("graph_id").agg(F.min_by(F.struct("mean", "sd"), F.struct("mean", "label")).alias("b"))
    rise = F.col("mean") - F.col("b.mean")
    return stats.join(F.broadcast(base), "graph_id").select("graph_id", "label", "size", "mean", "sd", F.when(F.col("b.sd") > 0, rise / F.col("b.sd")).otherwise(rise).alias("z"))


def critical(labelled: DataFrame) -> DataFrame:
    """graph_id, node, label and is_critical: in the cluster with the largest mean total (the lowest label of equals)."""
    top = labelled.groupBy("graph_id", "label").agg(F.avg("total").alias("m")).groupBy("graph_id").agg(F.max_by("label", F.struct("m", -F.col("label"))).alias("top"))
    return labelled.join(F.broadcast(top), "graph_id").select("graph_id", "node", "label", (F.col("label") == F.col("top")).alias("is_critical"))


def critical_nodes(cells: DataFrame, k_min: int = 2, k_max: int = 10) -> DataFrame:
    """From participation to critical nodes: crop, weight early steps, cluster with the best k, take the cluster with the
    largest mean sum. In a graph that ends with one cluster that is all of them."""
    weighted = profiles.fill(profiles.weight_linear(profiles.crop_longest(cells, "all")))
    labels = optimal_clusters(profiles.feature_vectors(weighted), k_min, k_max)
    return critical(labels.join(profiles.node_sums(weighted), ["graph_id", "node"]).select("graph_id", "node", "label", "total"))


def critical_nodes_by_area(cells: DataFrame) -> DataFrame:
    """The older rule: strict crop, flattened weights, two clusters, and the one with the larger mean Simpson area."""
    weighted = profiles.fill(profiles.weight_flattened(profiles.crop_longest(cells, "any")))
    labels = clusters(profiles.feature_vectors(weighted), 2)
    return critical(labels.join(profiles.area(weighted), ["graph_id", "node"]).select("graph_id", "node", "label", F.col("area").alias("total")))

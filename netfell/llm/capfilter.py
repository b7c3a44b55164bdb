"""Operator 1: near-duplicate vectors by spherical-cap filters.

A filter is a direction; a vector belongs to it if its cosine with the direction is at least alpha. Directions are
structured as random product codes: a rotation turns the vector, its two halves are compared with CODE unit vectors
each, and every pair of code vectors is a direction, so that all directions a vector exceeds are listed from 2 * CODE
inner products. Several rotations are used, each by itself. Vectors meet in their filters and are compared there in
double precision, in blocks of bounded size; a pair that shares several filters counts in the first of them only.
Nothing is listed by pairs: a filter returns the links each vector has there, and a spanning edge.

CODE grows with the square root of the number of vectors so that a filter holds a dozen of them at any size, and the
number of rotations with its logarithm. Two vectors at the threshold share a filter but for about one pair in 300
(README), closer ones more surely.

Vectors that are equal are one node with a count. A vector that is null, empty, zero or holds null or non-finite
components is linked with nothing and is its own component. Vectors of different length are not compared. Repeated rows
are equal vectors, and count as other vectors. component_id is the least vec_id of the component. Columns besides
vec_id and embedding are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netfell.llm.blockpairs import block_pairs, groups
from netfell.operators.components import component_labels
from netfell.scratch import Scratch

THRESHOLD = 0.95
#: Vectors that a filter holds on average, filters that a vector is in on average for each rotation.
FILTER_SIZE, PER_ROTATION = 12, 1.0
#: Filters with more vectors are compared block by block.
BLOCK = 2048


def cap(directions: int, dims: int, expected: float) -> float:
    """The cosine that a random vector has at least with ``expected`` of so many random directions."""
    t = np.linspace(0, 1, 200_001)[:-1]
    tail = np.cumsum(((1 - t * t) ** ((dims - 3) / 2))[::-1])[::-1]
    return float(t[min(np.searchsorted(-tail, -2 * tail[0] * expected / directions), len(t) - 1)])


class Codes:
    """The product codes for vectors of one length."""

    def __init__(self, dims: int, n: int):
        self.code = max(8, int(np.ceil(np.sqrt(n * PER_ROTATION / FILTER_SIZE))))
        self.rotations = max(24, 4 * int(np.ceil(np.log2(self.code))))
        self.alpha = cap(self.code**2, max(dims, 4), PER_ROTATION)
        self.dims = dims
        half = (dims + 1) // 2
        self.halves = (half, dims - half)

    def rotation(self, r: int) -> tuple[np.ndarray, list[np.ndarray]]:
        rng = np.random.default_rng([self.dims, self.code, r])
        turn = np.linalg.qr(rng.normal(size=(self.dims, self.dims)))[0]
        out = []
        for d in self.halves:
            c = rng.normal(size=(self.code, d))
            out.append((c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300) / np.sqrt(2)).T)
        return turn, out

    def filters(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For unit vectors: which of them is in which filter, in ascending order of vector and filter."""
        rows, found = [], []
        for r in range(self.rotations):
            turn, (a, b) = _rotation(self.dims, self.code, r, self)
            y = x @ turn
            left, right = y[:, : self.halves[0]] @ a, y[:, self.halves[0] :] @ b
            row, i = np.nonzero(left >= self.alpha - right.max(axis=1, keepdims=True))
            at, j = np.nonzero(right[row] >= (self.alpha - left[row, i])[:, None])
            rows.append(row[at])
            found.append((r * self.code + i[at]) * self.code + j)
        rows, found = np.concatenate(rows), np.concatenate(found)
        order = np.lexsort((found, rows))
        return rows[order], found[order]


@lru_cache(maxsize=256)
def _rotation(dims: int, code: int, r: int, codes: Codes) -> tuple[np.ndarray, list[np.ndarray]]:
    return codes.rotation(r)


def _sound(column: str) -> Column:
    x = F.col(column)
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce((F.size(x) > 0) & ~odd & F.exists(x, lambda v: v != 0), F.lit(False))


def units(raw: list[bytes], dtype: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def members(vectors: DataFrame, counts: dict[int, int], dtype: str) -> DataFrame:
    """A row for each vector and filter it is in: filter (with the length of vectors), node, copies, the vector and all
    its filters."""
    codes = {dims: Codes(dims, n) for dims, n in counts.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                dims = part.column(2).to_numpy()
                for d in np.unique(dims).tolist():
                    own = part.filter(pa.array(dims == d))
                    x = np.array(own.column(3).to_pylist(), dtype)
                    rows, found = codes[d].filters(units([v.tobytes() for v in x], dtype))
                    found = found << 12 | d
                    ends = np.searchsorted(rows, np.arange(len(x) + 1))
                    lists = [found[i:j].astype("<i8").tobytes() for i, j in zip(ends, ends[1:], strict=False)]
                    raw = [v.tobytes() for v in x]
                    at = pa.array(rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found), own.column(0).take(at), own.column(1).take(at), pa.array(raw, pa.binary()).take(at), pa.array(lists, pa.binary()).take(at)],
                        ["filter", "node", "copies", "vector", "filters"],
                    )

    return vectors.select("node", "copies", F.size("embedding").alias("dims"), "embedding").mapInArrow(run, "filter long, node long, copies long, vector binary, filters binary")


def _linked(x: np.ndarray, y: np.ndarray, filters_x: list[bytes], filters_y: list[bytes], here: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs are links, and which of those have no filter in common before this one."""
    link = x @ y.T >= THRESHOLD
    if not link.any():
        return link, link
    use_x, use_y = np.flatnonzero(link.any(axis=1)), np.flatnonzero(link.any(axis=0))
    earlier = [[np.frombuffer(own[i], "<i8") for i in use] for own, use in ((filters_x, use_x), (filters_y, use_y))]
    flat = [np.concatenate([f[f < here] for f in own]) for own in earlier]
    common = np.intersect1d(*flat)
    first = link.copy()
    if len(common):
        sides = []
        for own in earlier:
            side = np.zeros((len(own), len(common)), np.float32)
            for k, f in enumerate(own):
                f = f[f < here]
                at = np.minimum(np.searchsorted(common, f), len(common) - 1)
                side[k, at[common[at] == f]] = 1
            sides.append(side)
        first[np.ix_(use_x, use_y)] &= sides[0] @ sides[1].T == 0
    return link, first


def _roots(link: np.ndarray, offset: int) -> np.ndarray:
    """For each row and column of a link matrix the least member of its component; columns begin at ``offset``."""
    n = max(link.shape[0], offset + link.shape[1])
    label = np.arange(n)
    i, j = np.nonzero(link)
    j = j + offset
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compare(rows: DataFrame, dtype: str) -> DataFrame:
    """node, n_links (to vectors it first meets here) and root (a node of its component) for filters' members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches):
            yield from group(t)

    def group(t: pa.Table) -> Iterator[pa.RecordBatch]:
        here, a, b = (t.column(i)[0].as_py() for i in range(3))
        node, copies, block = t.column("node").to_numpy(), t.column("copies").to_numpy(), t.column("block").to_numpy()
        x, filters = units(t.column("vector").to_pylist(), dtype), t.column("filters").to_pylist()
        side = np.flatnonzero(block == a), np.flatnonzero(block == b)
        if a == b:
            link, first = _linked(x, x, filters, filters, here)
            np.fill_diagonal(link, False)
            np.fill_diagonal(first, False)
            n, root = first @ copies, _roots(link, 0)
            some = link.any(axis=1)
        else:
            link, first = _linked(x[side[0]], x[side[1]], [filters[i] for i in side[0]], [filters[i] for i in side[1]], here)
            n = np.concatenate([first @ copies[side[1]], first.T @ copies[side[0]]])
            root, some = _roots(link, len(side[0])), np.concatenate([link.any(axis=1), link.any(axis=0)])
            node = node[np.concatenate(side)]
        if some.any():
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(n[some].astype(np.int64)), pa.array(node[root[some]])], ["node", "n_links", "root"])

    return block_pairs(rows, "filter", "node", BLOCK).mapInArrow(run, "node long, n_links long, root long")


def near_duplicates(table: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of table(vec_id, embedding)."""
    scratch = Scratch(table.sparkSession, "capfilter")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").withColumn("sound", _sound("embedding"))
    rows = rows.withColumn("node", F.when(F.col("sound"), F.xxhash64("embedding")))
    dtype = "<f4" if "float" in dict(table.dtypes)["embedding"] else "<f8"
    vectors = rows.where("sound").groupBy("node").agg(F.any_value("embedding").alias("embedding"), F.count("*").alias("copies"), F.min("vec_id").alias("first_id"))
    vectors = scratch.write(vectors, "vectors")
    counts = {r["d"]: r["n"] for r in vectors.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).collect()}  # a row for each length
    made = scratch.write(members(vectors, counts, dtype), "members", "none")
    met = scratch.write(compare(made, dtype), "met")
    scratch.drop("members")
    labels = component_labels(met.select(F.col("node").alias("u"), F.col("root").alias("v")), scratch)
    linked = met.groupBy("node").agg(F.sum("n_links").alias("n"))
    named = vectors.select("node", "copies", "first_id").join(linked, "node", "left").join(labels, "node", "left")
    named = named.select("node", "first_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("first_id").alias("least_id"))
    nodes = scratch.write(named.join(least, "component").select("node", "n_links", "least_id"), "nodes")
    out = rows.select("vec_id", "node").join(nodes, "node", "left")
    component = F.coalesce("least_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))

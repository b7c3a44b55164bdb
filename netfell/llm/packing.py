"""Operator 10: documents packed into sequences by length patterns.

Documents become token pieces of at most ``size`` ids. Patterns of few lengths that fill a sequence exactly are listed;
non-negative least squares fits how often each is used to the histogram of lengths; the counts are rounded down to
what the histogram holds, and what is left is packed best fit first, a whole run of equal sequences at a time. The
plan depends on the histogram alone, of at most ``size`` numbers, so its size and the driver's work do not grow with
the corpus; each piece finds its place by its rank among the pieces of its length.

Null text is empty and has only the end id; an empty table gives no rows; repeated rows are packed each for itself;
columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netfell.llm.arrow import slices
from netfell.llm.piececache import encoder
from netfell.llm.workers import fresh
from netfell.scratch import Scratch

SIZE = 1024
#: Bytes of text encoded at a time; the pipeline's executors hold what earlier stages left.
TEXT_BYTES = 4 << 20


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int = 2, size: int = SIZE) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, and its task and rank in the task among equally
    long pieces. Only the first piece of a longer document is shorter than ``size``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end, task = encoder(vocabulary), np.array([end_id], "<u2").tobytes(), TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for batch in slices(batches, 1, TEXT_BYTES):
            rows: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "rank")}
            for doc_id, raw in zip(batch.column(0).to_pylist(), own.encode(batch.column(1).to_pylist()), strict=True):
                ids = np.frombuffer(raw + end, "<u2").astype("<u4")
                n, at = len(ids), 0
                view, first = memoryview(ids.tobytes()), len(ids) % size or size
                for piece, stop in enumerate(range(first, n + 1, size)):
                    rows["doc_id"].append(doc_id)
                    rows["piece"].append(piece)
                    rows["start"].append(at)
                    rows["length"].append(stop - at)
                    rows["ids_crc32"].append(zlib.crc32(view[4 * at : 4 * stop]))
                    rows["rank"].append(int(seen[stop - at]))
                    seen[stop - at] += 1
                    at = stop
            yield pa.RecordBatch.from_pydict(rows | {"task": [task] * len(rows["piece"])}, schema=_PIECE)

    picked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return picked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, rank long, task int")


_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("rank", pa.int64()), ("task", pa.int32())])


def patterns(size: int, lengths: np.ndarray) -> list[tuple[int, ...]]:
    """Tuples of one to four of the lengths that add up to ``size``: all singles and pairs, and threes and fours on a
    coarse grid of their smaller members."""
    held = set(lengths.tolist())
    found = {(size,)} & {(n,) for n in held}
    found |= {(a, size - a) for a in held if 2 * a >= size and size - a in held}
    grid = sorted(held)[:: max(1, len(held) // 48)]
    for i, a in enumerate(grid):
        for b in grid[i:]:
            if (c := size - a - b) >= b and c in held:
                found.add((c, b, a))
        for b in grid[i :: 6]:
            if (c := (size - a - b) // 2) >= b and (d := size - a - b - c) in held and c in held:
                found.add((d, c, b, a))
    return sorted((tuple(sorted(p, reverse=True)) for p in found), key=lambda p: (len(p), p))


def fit(histogram: np.ndarray, listed: list[tuple[int, ...]], rounds: int = 200) -> np.ndarray:
    """Non-negative repeat counts of the patterns whose lengths come nearest to the histogram in squared error, by
    coordinate descent: the few large patterns first, so that solutions stay sparse."""
    used = [np.unique(p, return_counts=True) for p in listed]
    norms = [float((m * m).sum()) for _, m in used]
    x, left = np.zeros(len(listed)), histogram.astype(float)
    for _ in range(rounds):
        moved = 0.0
        for j, (at, m) in enumerate(used):
            new = max(0.0, x[j] + float(left[at] @ m) / norms[j])
            if (step := new - x[j]) != 0.0:
                left[at] -= step * m
                x[j] = new
                moved = max(moved, abs(step))
        if moved < 0.25:
            break
    return x


def plan(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how often each is used, which together hold each length exactly as often as the histogram."""
    size, left = len(histogram) - 1, histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []

    def use(pattern: tuple[int, ...], most: int) -> None:
        at, m = np.unique(pattern, return_counts=True)
        n = min(most, int((left[at] // m).min()))
        if n > 0:
            left[at] -= n * m
            out.append((pattern, n))

    listed = patterns(size, np.flatnonzero(left))
    counts = fit(left, listed)
    for j in np.argsort(-counts, kind="stable"):
        use(listed[j], int(counts[j] + 1e-6))
    while (held := np.flatnonzero(left)).size:
        pattern, room, rest = [], size, left.copy()
        while held.size:
            n = int(held[-1])
            pattern.append(n)
            rest[n] -= 1
            room -= n
            held = held[held <= room]
            held = held[rest[held] > 0]
        use(tuple(pattern), 1 << 62)
    return out


class Places:
    """Where the pieces of each length go: by rank, the sequence and the offset in it."""

    def __init__(self, planned: list[tuple[tuple[int, ...], int]], size: int):
        parts: dict[int, list[tuple[int, int, list[int]]]] = {}
        filled, base = np.zeros(size + 1, np.int64), 0
        for pattern, n in planned:
            offsets: dict[int, list[int]] = {}
            at = 0
            for length in pattern:
                offsets.setdefault(length, []).append(at)
                at += length
            for length, own in offsets.items():
                parts.setdefault(length, []).append((int(filled[length]), base, own))
                filled[length] += n * len(own)
            base += n
        self.sequences = base
        self.of = {n: (np.array([x[0] for x in own]), np.array([x[1] for x in own]), [np.array(x[2]) for x in own]) for n, own in parts.items()}

    def find(self, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, base, offsets = self.of[length]
        part = np.searchsorted(first, rank, side="right") - 1
        sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for p in np.unique(part):
            at, own = part == p, offsets[p]
            nth = rank[at] - first[p]
            sequence[at], offset[at] = base[p] + nth // len(own), own[nth % len(own)]
        return sequence, offset


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """sequence_id and offset for pieces with doc_id, piece, start, length, ids_crc32, task and rank, where rank counts
    from 0 within task and length."""
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    histogram = np.zeros(size + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``size`` rows
        histogram[r["length"]] = r["n"]
    places = Places(plan(histogram), size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy() + batch.column("before").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                at = length == n
                sequence[at], offset[at] = places.find(int(n), rank[at])
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    ranked = pieces.join(first, ["task", "length"])
    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 2, size: int = SIZE) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "packing")
    return pack(scratch.write(token_pieces(docs, vocabulary, end_id, size), "pieces"), size)

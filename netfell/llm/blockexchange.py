"""Global counts and firsts by key without a row for each key.

A block is the work of one task: some documents, and the distinct keys found in them. Each block sends its keys, sorted
and packed, to buckets by the keys' top bits, with one small number a key; a bucket merges all blocks' numbers for a key
and tells each block the outcome, in the order sent. So a key that is in every document costs one entry a block, no task
holds a key's rows, and the JVM moves a few large binary rows in place of one for each key.

There are about as many buckets as blocks, so that a bucket stays as small as a block. With more than 2**RADIX of them
the keys go level by level, as through the switches of a network: on each level a group of about 2**RADIX runs that
share their keys' first bits is merged to one run for each of the next 2**RADIX values of the bits after them, and what
the last level finds goes back the same way. A level's rows are at most 2**RADIX a block, and none are empty; what a
task holds does not grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netfell.llm.words import mix
from netfell.llm.workers import fresh
from netfell.scratch import Scratch

#: A block or a group of blocks sends to 2**RADIX buckets at most.
RADIX = 10


def pack_small(x: np.ndarray) -> bytes:
    """Unsigned numbers, mostly under 255: a byte each, and for the others as many bytes as the largest takes."""
    big = x[x >= 255].astype("<u8")
    width = (int(big.max()).bit_length() + 7) // 8 if len(big) else 0
    return b"".join([np.array([len(x), width], "<u4").tobytes(), np.minimum(x, 255).astype(np.uint8).tobytes(), np.ascontiguousarray(big.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()])


def unpack_small(data: bytes) -> np.ndarray:
    n, width = np.frombuffer(data, "<u4", 2).tolist()
    x = np.frombuffer(data, np.uint8, n, 8).astype(np.uint64)
    if width:
        raw = np.frombuffer(data, np.uint8, offset=8 + n).reshape(-1, width)
        big = np.zeros((len(raw), 8), np.uint8)
        big[:, :width] = raw
        x[x == 255] = big.reshape(-1).view("<u8")
    return x


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit keys: the steps between them, in as few bytes each as the largest takes; a last byte
    that is 0 in all keys is left out."""
    if not len(keys):
        return b""
    shift = 0 if (keys & np.uint64(255)).any() else 8
    steps = np.diff(keys >> np.uint64(shift))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    head = np.array([width + (shift << 8), keys[0]], "<u8").tobytes()
    return head + np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    head, first = np.frombuffer(data, "<u8", 2).tolist()
    width, shift = head & 255, np.uint64(head >> 8)
    raw = np.frombuffer(data, np.uint8, offset=16).reshape(-1, width)
    steps = np.zeros((len(raw) + 1, 8), np.uint8)
    steps[1:, :width] = raw
    steps = steps.reshape(-1).view("<u8")
    steps[0] = np.uint64(first) >> shift
    return np.cumsum(steps, dtype=np.uint64) << shift


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


BLOCKS = "block long, payload binary"
_BLOCKS = pa.schema([("block", pa.int64()), ("payload", pa.binary())])
#: Rows of a level: bucket, group of runs, the run's source (-1: the group's merged run), and packed data.
_PART = pa.schema([("bucket", pa.int64()), ("team", pa.int64()), ("source", pa.int64()), ("data", pa.binary())])
_PARTS = "bucket long, team long, source long, data binary"
_REPLY = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("data", pa.binary()), ("sums", pa.map_(pa.string(), pa.float64()))])


def block_rows(task: int, payloads: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    """Rows of a table of BLOCKS, numbered by task."""
    for i, payload in enumerate(payloads):
        yield pa.RecordBatch.from_pydict({"block": [(task << 24) + i], "payload": [squeeze(payload)]}, schema=_BLOCKS)


@dataclass
class Answer:
    """What becomes of the numbers sent for equal keys. ``merge(kind, numbers, first)`` makes one number of those from
    each ``first`` to the next, and may be given its own results; ``tell(kind, merged, own)`` is what a block hears, from
    the outcome and its own number; ``sums(kind, merged)`` are sums for the whole."""

    merge: Callable[[int, np.ndarray, np.ndarray], np.ndarray]
    tell: Callable[[int, np.ndarray, np.ndarray], np.ndarray] = lambda kind, merged, own: merged
    sums: Callable[[int, np.ndarray], dict[str, float]] = lambda kind, merged: {}

    def __call__(self, kind: int, keys: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, dict[str, float]]:
        """What each of these entries of one bucket, sorted by key, is told, and the sums."""
        first, merged = self.merged(kind, keys, numbers)
        return self.tell(kind, np.repeat(merged, np.diff(np.append(first, len(keys)))), numbers), self.sums(kind, merged)

    def merged(self, kind: int, keys: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(0, np.int64), numbers
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return first, self.merge(kind, numbers, first)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of Python values, one large value at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in batch.columns)


def _part(schema: pa.Schema, *values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)


def split_keys(kinds: list[tuple[np.ndarray, np.ndarray]], shift: int, bucket: int, fan: int) -> Iterator[tuple[int, bytes]]:
    """The buckets from ``bucket`` on, of ``fan``, that have any of the keys, with those keys and their numbers."""
    cuts = [np.searchsorted(keys >> np.uint64(shift), np.arange(bucket, bucket + fan + 1, dtype=np.uint64)) for keys, _ in kinds]
    for i in np.flatnonzero(sum(np.diff(c) for c in cuts)).tolist():
        yield bucket + i, pack_parts([x for (keys, numbers), c in zip(kinds, cuts, strict=True) for x in (pack_keys(keys[c[i] : c[i + 1]]), pack_small(numbers[c[i] : c[i + 1]]))])


def _entries(data: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
    parts = unpack_parts(data)
    return [(unpack_keys(k), unpack_small(n)) for k, n in zip(parts[::2], parts[1::2], strict=True)]


def _together(asked: list[list[tuple[np.ndarray, np.ndarray]]], kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """All entries of a kind: keys and numbers sorted by key, their order, and where each asker's entries end."""
    keys = [x[kind][0] for x in asked]
    flat = np.concatenate(keys)
    order = np.argsort(flat, kind="stable")
    return flat[order], np.concatenate([x[kind][1] for x in asked])[order], order, np.cumsum([len(k) for k in keys]).tolist()


def exchange(blocks: DataFrame, keys_of: Callable[[bytes], list[tuple[np.ndarray, np.ndarray]]], answer: Answer, scratch: Scratch, name: str, radix: int = RADIX) -> tuple[DataFrame, dict[str, float]]:
    """Ask about every block's keys.

    keys_of(payload) gives, for each kind of key, ascending distinct keys and a small number for each. Returns a table
    (block, bucket, data) to be read by ``answers``, and the sums over all buckets.
    """
    spark = blocks.sparkSession
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(4, (max(1, blocks.count()) * 3 // 4).bit_length())
    levels = -(-bits // radix)
    step = -(-bits // levels)
    fan = 1 << step
    shift = [64 - step * (i + 1) for i in range(levels)]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        for block, payload in _rows(batches):
            team = int(mix(np.array([block], np.uint64))[0]) % fan ** (levels - 1)
            for bucket, data in split_keys(keys_of(unsqueeze(payload)), shift[0], 0, fan):
                yield _part(_PART, bucket, team, block, data)

    def ask_on(level: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for bucket, team, _, data in _rows(batches):
                for inner, part in split_keys(_entries(data), shift[level], bucket * fan, fan):
                    yield _part(_PART, inner, team // fan, team, part)

        return run

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows as they came, and for each bucket and team their merged run."""
        for (bucket, team), own in groupby(_rows(batches), key=lambda r: r[:2]):
            asked = []
            for row in own:
                asked.append(_entries(row[3]))
                yield _part(_PART, *row)
            run: list[bytes] = []
            for kind in range(len(asked[0])):
                keys, numbers, _, _ = _together(asked, kind)
                first, merged = answer.merged(kind, keys, numbers)
                run += [pack_keys(keys[first]), pack_small(merged)]
            yield _part(_PART, bucket, team, -1, pack_parts(run))

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, own in groupby(_rows(batches), key=lambda r: r[0]):
            rows = list(own)
            asked = [_entries(r[3]) for r in rows]
            sources = [r[2] for r in rows]
            del rows
            said: list[list[bytes]] = [[] for _ in asked]
            sums: dict[str, float] = {}
            for kind in range(len(asked[0])):
                keys, numbers, order, ends = _together(asked, kind)
                first, merged = answer.merged(kind, keys, numbers)
                told = np.repeat(merged, np.diff(np.append(first, len(keys))))
                back = np.empty(len(keys), np.uint64)
                back[order] = told if levels > 1 else answer.tell(kind, told, numbers)
                for to, part in zip(said, np.split(back, ends[:-1]), strict=True):
                    to.append(pack_small(part))
                for k, v in answer.sums(kind, merged).items():
                    sums[k] = sums.get(k, 0) + v
            for source, parts in zip(sources, said, strict=True):
                yield _part(_REPLY, source, bucket, pack_parts(parts), None)
            yield _part(_REPLY, -1, bucket, None, list(sums.items()))

    def hand_back(first_level: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (bucket, _), own in groupby(_rows(batches), key=lambda r: r[:2]):
                rows = list(own)
                told = [unpack_parts(r[4]) for r in rows if r[2] == 0]
                asked = [(r[3], _entries(r[4])) for r in rows if r[2] == 1]
                del rows
                outcome = []
                for kind in range(len(asked[0][1])):
                    known = np.unique(np.concatenate([x[kind][0] for _, x in asked]))
                    outcome.append((known, np.concatenate([unpack_small(t[kind]) for t in told])))
                for source, entries in asked:
                    out = []
                    for kind, (keys, numbers) in enumerate(entries):
                        known, merged = outcome[kind]
                        own_merged = merged[np.searchsorted(known, keys)] if len(keys) else merged[:0]
                        out.append(pack_small(answer.tell(kind, own_merged, numbers) if first_level else own_merged))
                    yield _part(_REPLY, source, bucket, pack_parts(out), None)

        return run

    replies_schema = "block long, bucket long, data binary, sums map<string,double>"
    asked = blocks.mapInArrow(ask, _PARTS)
    for level in range(1, levels):
        dealt = asked.repartition(max(wide, fan), "bucket", "team").sortWithinPartitions("bucket", "team", "source")
        up = scratch.write(dealt.mapInArrow(merge, _PARTS), f"{name}-up-{level}", "none")
        asked = up.where("source = -1").mapInArrow(ask_on(level), _PARTS)
    tasks = min(fan**levels, max(wide, fan))
    dealt = asked.repartitionById(tasks, F.pmod("bucket", F.lit(tasks)).cast("int")).sortWithinPartitions("bucket", "source")
    last = scratch.write(dealt.mapInArrow(reply, replies_schema), f"{name}-{levels}")
    sums = last.where("block = -1").select(F.explode("sums")).groupBy("key").agg(F.sum("value").alias("value")).collect()
    replies = last.where("block >= 0").select("block", "bucket", "data")
    for level in range(levels - 1, 0, -1):
        parts = scratch.spark.read.schema(_PARTS).parquet(scratch.path(f"{name}-up-{level}")).where("source >= 0")
        said = replies.select(F.expr(f"bucket DIV {fan}").alias("bucket"), F.col("block").alias("team"), F.lit(0).alias("kind"), F.col("bucket").alias("place"), "data")
        both = said.unionByName(parts.select("bucket", "team", F.lit(1).alias("kind"), F.col("source").alias("place"), "data"))
        dealt = both.repartition(max(wide, fan), "bucket", "team").sortWithinPartitions("bucket", "team", "kind", "place")
        replies = scratch.write(dealt.mapInArrow(hand_back(level == 1), replies_schema), f"{name}-{level}").select("block", "bucket", "data")
        scratch.drop(f"{name}-up-{level}")
        scratch.drop(f"{name}-{level + 1}")
    return replies, {r["key"]: r["value"] for r in sums}


def pack_parts(parts: list[bytes]) -> bytes:
    return b"".join([np.array([len(parts), *map(len, parts)], "<u4").tobytes(), *parts])


def unpack_parts(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    sizes = np.frombuffer(data, "<u4", n, 4).tolist()
    ends = np.cumsum([4 + 4 * n, *sizes]).tolist()
    return [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def answers(blocks: DataFrame, replies: DataFrame, kinds: int, finish: Callable[[int, bytes, list[np.ndarray]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """finish(block, payload, numbers) for every block, where numbers has, for each kind of key, what the block is told,
    in the order of its keys."""
    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = blocks.select("block", F.lit(-1).cast("long").alias("bucket"), F.col("payload").alias("data")).unionByName(replies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        for block, own in groupby(_rows(batches), key=lambda r: r[0]):
            payload = unsqueeze(next(own)[2])
            parts = [unpack_parts(r[2]) for r in own]
            yield from finish(block, payload, [np.concatenate([np.zeros(0, np.uint64), *(unpack_small(p[k]) for p in parts)]) for k in range(kinds)])

    return both.repartition(tasks, "block").sortWithinPartitions("block", "bucket").mapInArrow(run, schema)

"""Operator 2: token ids as files of frequency-ranked, byte-aligned variable-length codes.

Ids are replaced by their rank in the corpus (the most frequent id is 0), so that most take one byte. Control bytes,
two bits an id, stand apart from the data bytes; numpy looks each control byte up in a table of 256 rows to place
four ids' data at once. A file holds blocks of documents in ascending doc_id order (null first; equal ids in order of
their tokens), and a small table beside them gives the ids by rank. Blocks are rows of binary data in Parquet, so any
store that Spark reaches will do, and a lost executor costs one shard's rerun.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netfell.llm.arrow import slices
from netfell.llm.piececache import TEXT_BYTES, encoder
from netfell.scratch import Scratch

MAGIC = b"RVB1"
#: Ids in a block, at which it is closed.
BLOCK_IDS = 1 << 18

_LENGTHS = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)], np.uint8)
_PLACES = (np.arange(4) < _LENGTHS[:, :, None]).reshape(256, 16)


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit ranks."""
    padded = np.zeros(-(-len(ranks) // 4) * 4, "<u4")
    padded[: len(ranks)] = ranks
    lengths = (padded > 0xFF).astype(np.uint8) + (padded > 0xFFFF) + (padded > 0xFFFFFF)
    control = (lengths.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    return control.tobytes(), padded.view(np.uint8).reshape(-1, 16)[_PLACES[control]].tobytes()


def unpack_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The first n ranks back from control and data bytes."""
    out = np.zeros((len(control), 16), np.uint8)
    out[_PLACES[control]] = data
    return out.reshape(-1).view("<u4")[:n]


def pack_block(doc_ids: list[int | None], counts: np.ndarray, ranks: np.ndarray) -> bytes:
    control, data = pack_ranks(ranks)
    head = np.array([len(doc_ids), len(ranks), len(control), len(data)], "<u8").tobytes()
    known = np.array([d is not None for d in doc_ids], np.uint8)
    return b"".join([MAGIC, head, known.tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), counts.astype("<u8").tobytes(), control, data])


def unpack_block(block: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    if block[:4] != MAGIC:
        raise ValueError("not a block of ranked ids")
    docs, n, n_control, n_data = np.frombuffer(block, "<u8", 4, 4).tolist()
    at = 36
    known = np.frombuffer(block, np.uint8, docs, at)
    ids = np.frombuffer(block, "<i8", docs, at + docs)
    counts = np.frombuffer(block, "<u8", docs, at + 9 * docs)
    at += 17 * docs
    ranks = unpack_ranks(np.frombuffer(block, np.uint8, n_control, at), np.frombuffer(block, np.uint8, n_data, at + n_control), n)
    return [d if k else None for d, k in zip(ids.tolist(), known, strict=True)], counts.astype(np.int64), ranks


#: Bytes of encoded parts that a worker keeps; no other operator runs beside this one.
KEPT_BYTES = 320 << 20


def encode_documents(docs: DataFrame, vocabulary: str, end_id: int, bounds: list[int]) -> DataFrame:
    """doc_id, shard (by the bounds), n and ids (little-endian unsigned 16-bit) of every whole text; null is empty."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = encoder(vocabulary, most=KEPT_BYTES), np.array([end_id], "<u2").tobytes()
        for batch in slices(batches, 1, TEXT_BYTES):
            ids = [x + end for x in own.encode(batch.column(1).to_pylist())]
            numbers = batch.column(0).to_pandas()
            shard = np.where(numbers.isna(), 0, np.searchsorted(bounds, numbers.fillna(0).astype(np.int64), side="right"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(shard, pa.int32()), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "shard", "n", "ids"]
            )

    picked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return picked.mapInArrow(encode, "doc_id long, shard int, n long, ids binary")


def ids_by_rank(encoded: DataFrame) -> np.ndarray:
    """All ids that occur, the most frequent first, the smaller first among equals. At most a vocabulary of numbers
    reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in slices(batches, 0):
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u2"), minlength=1 << 16)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found], pa.int64())], ["id", "c"])

    counted = encoded.select("ids").mapInArrow(count, "id int, c long").groupBy("id").agg(F.sum("c").alias("c"))
    rows = counted.orderBy(F.desc("c"), "id").collect()
    return np.array([r["id"] for r in rows], np.uint32)


def write_ids(docs: DataFrame, vocabulary: str, end_id: int, scratch: Scratch) -> None:
    """Write scratch tables ``ids`` (the blocks) and ``ranks`` (the ids by rank) for all documents.

    Columns besides doc_id and text are ignored. An empty table gives empty files."""
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = [i / shards for i in range(1, shards)] or [0.5]
    bounds = sorted(set(docs.select(F.percentile_approx(F.col("doc_id").cast("long"), at, 10 * shards + 1000)).first()[0] or []))
    encoded = scratch.write(encode_documents(docs, vocabulary, end_id, bounds), "encoded")
    ranked = ids_by_rank(encoded)
    rank_of = np.zeros(1 << 16, np.uint32)
    rank_of[ranked] = np.arange(len(ranked), dtype=np.uint32)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, n, before, number, shard = [], [], 0, 0, 0, None

        def closed() -> pa.RecordBatch:
            counts = np.array([len(x) // 2 for x in held], np.int64)
            blob = pack_block(names, counts, rank_of[np.frombuffer(b"".join(held), "<u2")])
            return pa.RecordBatch.from_pydict({"shard": [shard], "block": [number], "before": [before], "n_ids": [n], "data": [blob]}, schema=_BLOCK)

        for batch in slices(batches, 2):
            for doc_id, own, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != shard:
                    if names:
                        yield closed()
                    names, held, n, before, number, shard = [], [], 0, 0, 0, own
                names.append(doc_id)
                held.append(ids)
                n += len(ids) // 2
                if n >= BLOCK_IDS:
                    yield closed()
                    names, held, before, n, number = [], [], before + n, 0, number + 1
        if names:
            yield closed()

    by_shard = encoded.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", "doc_id", "n", "ids")
    blocks = by_shard.select("doc_id", "shard", "ids").mapInArrow(block, "shard int, block int, before long, n_ids long, data binary")
    scratch.write(blocks, "ids")
    scratch.write(spark.createDataFrame(pd.DataFrame({"ids": [ranked.astype("<u4").tobytes()]}), "ids binary"), "ranks")
    scratch.drop("encoded")


_BLOCK = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("data", pa.binary())])


def read_ids(scratch: Scratch, each, schema: str) -> DataFrame:
    """Read the files back. ``each(doc_ids, starts, counts, ids)`` turns a block into an Arrow batch of ``schema``;
    starts count the ids of all documents before, ids are unsigned 32-bit."""
    spark = scratch.spark
    blocks = spark.read.schema("shard int, block int, before long, n_ids long, data binary").parquet(scratch.path("ids"))
    ranked = np.frombuffer(spark.read.schema("ids binary").parquet(scratch.path("ranks")).first()[0], "<u4")
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()  # a row for each file shard
    base, at = {}, 0
    for r in totals:
        base[r["shard"]] = at
        at += r["n"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            for shard, before, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                doc_ids, counts, ranks = unpack_block(data)
                starts = base[shard] + before + np.cumsum(counts) - counts
                yield each(doc_ids, starts, counts, ranked[ranks])

    return blocks.select("shard", "before", "data").mapInArrow(decode, schema)


def digest(doc_ids: list, starts: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """A row for each document of a block, with the crc32 of its ids."""
    raw, ends = memoryview(np.ascontiguousarray(ids, "<u4").tobytes()), (np.cumsum(counts) * 4).tolist()
    crc = [zlib.crc32(raw[end - 4 * n : end]) for end, n in zip(ends, counts.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
    )


def token_file(docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    """Write all documents' ids, read the files back and give each document's start, length and crc32."""
    scratch = Scratch(docs.sparkSession, "tokenfile")
    write_ids(docs, vocabulary, end_id, scratch)
    return read_ids(scratch, digest, "doc_id long, start long, n_tokens long, ids_crc32 long")

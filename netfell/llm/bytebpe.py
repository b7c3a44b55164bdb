"""Operator 4: byte-level BPE by overlapping chunks, and decoding to raw bytes.

Long texts are cut into chunks that overlap. Each chunk is pre-tokenised by itself, on any executor; neighbours are
stitched at the first place in their overlap where both have a boundary, from which both must agree, as a match of the
pattern depends on nothing before it. The pieces of the stitched sequence are encoded by rank. Decoding joins the raw
bytes of the ids.

Null text is empty: no ids. Rows are handled one by one, so repeated rows and repeated doc_ids stay apart; columns
besides doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netfell.llm.arrow import slices
from netfell.llm.workers import kept

#: Characters of a chunk, and least characters that it shares with the next.
CHUNK, OVERLAP = 1 << 15, 256
#: Pieces kept per Python worker; beyond it the table starts anew.
KEPT_PIECES = 500_000
#: A chunk's boundary is sure if this many characters and one that isn't blank follow it within the chunk.
AHEAD = 4
#: Where any pre-tokenisation has a boundary, whatever comes before.
_SURE = regex.compile(r"(?<=[^\s\x1c-\x1f])(?= [^\s\x1c-\x1f])")


class RankEncoder:
    """Pieces to ids by the file's ranks; ids to bytes and to decimals."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.pieces = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.decimal = {i: str(i) for i in self.bytes_of}
        self.known: dict[str, bytes] = {}

    def ends(self, text: str) -> list[int]:
        """Where each match of the pattern ends."""
        return [m.end() for m in self.pattern.finditer(text)]

    def ids(self, pieces: list[str]) -> bytes:
        """The pieces' ids, as little-endian unsigned 32-bit integers."""
        known = self.known
        if len(known) > KEPT_PIECES:
            known.clear()
        for p in {p for p in pieces if p not in known}:
            known[p] = np.array(self.pieces._encode_single_piece(p), "<u4").tobytes()
        return b"".join(map(known.__getitem__, pieces))


def encoder(path: str, pattern: str) -> RankEncoder:
    """This worker's encoder, kept until the worker runs another operator."""
    return kept(("bytebpe", path, pattern), lambda: RankEncoder(path, pattern))


def chunks(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[tuple[int, str]]:
    """Start and text of each chunk. Every overlap holds a place where both chunks must have a boundary; where the
    text has none for a while, the chunk goes on."""
    at = 0
    while True:
        sure = _SURE.search(text, at + chunk + overlap) if at + chunk + overlap < len(text) else None
        if sure is None or sure.start() + AHEAD >= len(text):
            yield at, text[at:]
            return
        yield at, text[at : sure.start() + AHEAD + 1]
        at = sure.start() - overlap


def sure_ends(text: str, ends: list[int], last: bool) -> list[int]:
    """The ends that more text after the chunk could not move. All of them in a text's last chunk."""
    limit = len(text) if last else min(len(text) - AHEAD, len(text.rstrip()) - 1)
    return [e for e in ends if e <= limit]


def stitch(parts: list[tuple[int, list[int]]], length: int) -> list[int]:
    """The whole text's boundaries from the chunks' starts and sure ends (counted from the text's start)."""
    out: list[int] = []
    for (start, ends), following in zip(parts, [*parts[1:], None], strict=True):
        after = out[-1] if out else 0
        own = [e for e in ends if e > after]
        if following is None:
            out += own
            break
        common = {following[0], *following[1]}
        meet = next((e for e in own if e > following[0] and e in common), None)
        if meet is None:
            raise ValueError("neighbouring chunks have no boundary in common")
        out += [e for e in own if e <= meet]
    if length and (not out or out[-1] != length):
        raise ValueError("the pattern does not cover the text")
    return out


def encode(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers) of every whole text."""
    picked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    is_long = F.coalesce(F.length("text") > chunk + overlap, F.lit(False))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        cut = own.pattern.findall
        for batch in slices(batches, 1):
            yield _batch(batch.column(0), [own.ids(cut(t)) if t else b"" for t in batch.column(1).to_pylist()])

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in slices(batches, 1):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                row += 1
                for at, part in chunks(text, chunk, overlap):
                    yield pa.RecordBatch.from_pydict({"row": [row], "doc_id": [doc_id], "at": [at], "last": [at + len(part) == len(text)], "text": [part]}, schema=_CHUNK)

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in slices(batches, 4):
            for row, doc_id, at, last, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ends = sure_ends(text, own.ends(text), last)
                pieces = [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]
                counts = [len(own.ids([p])) // 4 for p in pieces]
                out = {"row": [row], "doc_id": [doc_id], "at": [at], "ends": [[at + e for e in ends]], "counts": [counts], "ids": [own.ids(pieces)]}
                yield pa.RecordBatch.from_pydict(out, schema=_TOKENISED)

    def stitched(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["at"])
        bounds = set(stitch([(r["at"], r["ends"]) for r in rows], rows[-1]["ends"][-1]))
        out, done = [], 0
        for r in rows:
            ends = np.array(r["ends"], np.int64)
            use = (ends > done) & np.isin(ends, list(bounds)) if done else np.isin(ends, list(bounds))
            stop = np.cumsum(np.array(r["counts"], np.int64)) * 4
            if not use.any():
                continue
            first, final = np.flatnonzero(use)[[0, -1]]
            out.append(r["ids"][stop[first - 1] if first else 0 : stop[final]])
            done = int(ends[final])
        return pa.table({"doc_id": pa.array([rows[0]["doc_id"]], pa.int64()), "ids": pa.array([b"".join(out)], pa.binary())})

    short = picked.where(~is_long).mapInArrow(whole, "doc_id long, ids binary")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = picked.where(is_long).mapInArrow(chunked, "row long, doc_id long, at long, last boolean, text string").repartition(tasks, "row", "at")
    long_ids = pieces.mapInArrow(tokenised, "row long, doc_id long, at long, ends array<long>, counts array<long>, ids binary")
    return short.unionByName(long_ids.groupBy("row").applyInArrow(stitched, "doc_id long, ids binary"))


_CHUNK = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("last", pa.bool_()), ("text", pa.string())])
_TOKENISED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("ends", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("ids", pa.binary())])


def _batch(doc_ids: pa.Array, ids: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([doc_ids, pa.array(ids, pa.binary())], ["doc_id", "ids"])


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = encoder(path, pattern).bytes_of.__getitem__
        for batch in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b"".join(map(get, np.frombuffer(x, "<u4").tolist())) for x in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode every text, decode its ids, and give doc_id, n_tokens, ids_sha256 and decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in slices(batches, 1):
            out: tuple[list, list, list] = ([], [], [])
            for raw in batch.column(1).to_pylist():
                ids = np.frombuffer(raw, "<u4").tolist()
                out[0].append(len(ids))
                out[1].append(hashlib.sha256(",".join(map(own.decimal.__getitem__, ids)).encode()).hexdigest())
                out[2].append(hashlib.sha256(b"".join(map(own.bytes_of.__getitem__, ids))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1]), pa.array(out[2])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encode(docs, path, pattern).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

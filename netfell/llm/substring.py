"""Operator 6: repeated passages removed by sliding sentence spans.

A sentence ends with a word that ends in ``.``, ``!`` or ``?``, or before a line end. Every run of RUN consecutive
sentences with at least RUN_WORDS words is hashed, and so that long sentences count too, every shorter run of at least
LONG_WORDS. That leaves repeats of many very short sentences and of one or two middling ones; with ``whole`` every
passage of whole sentences with at least RUN_WORDS words counts, however many sentences it takes: runs up to RUN have
that one floor, and from every sentence on, and up to every sentence, so has the shortest longer run that reaches it.
The registered query and the pipeline go without, as the SQL does.

Spans are joined globally by ``blockexchange``: the first occurrence of a span is the earliest in the
document with the smallest doc_id; a sentence that any other occurrence covers is removed, with the blanks after it.

Words are compared with A-Z lower-cased, whatever blanks are between them, by 64-bit numbers. Null text stays null, and
has no sentences; so has empty text. Rows that share a doc_id each count as the document with that doc_id, so the
earliest occurrence in each of them is a first one; a null doc_id comes after all others. Columns besides doc_id and
text are ignored by ``remove`` and kept by ``remove_from``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from netfell.llm.arrow import buffer, sizes, slices
from netfell.llm.blockexchange import BLOCKS, Answer, answers, block_rows, exchange
from netfell.llm.words import mix, placed_words
from netfell.llm.workers import fresh
from netfell.scratch import Scratch

RUN, RUN_WORDS, LONG_WORDS = 3, 15, 40
BLOCK_BYTES = 8 << 20
_BASE = 0x9FB21C651E98DF25
_STOPS = np.zeros(256, bool)
_STOPS[[ord(c) for c in ".!?"]] = True
_SCHEMA = "row string, doc_id long, text string, n_sentences long, n_removed long, n_removed_words long"


class Sentences:
    """The sentences of some texts: hash, words, text, and the bytes from its first word to the next sentence's."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        numbers, starts, stops = placed_words(data, ends)
        owner = np.searchsorted(ends, starts, side="right") - 1
        lines = np.concatenate([[0], np.cumsum(data == 10)])
        last = _STOPS[data[stops - 1]]
        if len(starts):
            last[:-1] |= (owner[1:] != owner[:-1]) | (lines[starts[1:]] > lines[stops[:-1]])
            last[-1] = True
        first = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1]).astype(np.int64)[: int(last.sum())]
        self.words = np.diff(np.append(first, len(starts)))
        self.owner = owner[first]
        self.starts = starts[first]
        place = np.arange(len(starts)) - np.repeat(first, self.words)
        spread = mix(numbers + place.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        self.hash = mix(np.add.reduceat(spread, first)) if len(first) else np.zeros(0, np.uint64)
        same = np.append(self.owner[1:] == self.owner[:-1], False) if len(first) else np.zeros(0, bool)
        self.stops = np.where(same, np.append(self.starts[1:], 0), ends[self.owner + 1])

    def spans(self, whole: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, first sentence and number of sentences of every span."""
        n, out = len(self.hash), []
        for m in range(1, RUN + 1):
            if n < m:
                break
            at = np.arange(n - m + 1)
            total = sum(self.words[i : n - m + 1 + i] for i in range(m))
            key = np.full(len(at), m, np.uint64)
            for i in range(m):
                key = mix(key * np.uint64(0x9FB21C651E98DF25) + self.hash[i : n - m + 1 + i])
            use = (self.owner[at] == self.owner[at + m - 1]) & (total >= (RUN_WORDS if m == RUN or whole else LONG_WORDS))
            out.append((key[use], at[use], np.full(int(use.sum()), m)))
        if whole and n:
            out.append(self._longer())
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _longer(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Spans of more than RUN sentences: the shortest with RUN_WORDS words from every sentence on and up to it."""
        n, before = len(self.hash), np.concatenate([[0], np.cumsum(self.words)])
        stop = np.searchsorted(before, before[:-1] + RUN_WORDS)
        start = np.searchsorted(before, before[1:] - RUN_WORDS, side="right") - 1
        at, end = np.concatenate([np.arange(n), start]), np.concatenate([stop, np.arange(1, n + 1)])
        use = (at >= 0) & (end <= n) & (end - at > RUN)
        at, end = at[use], end[use]
        use = self.owner[at] == self.owner[end - 1]
        at, m = np.divmod(np.unique(at[use] * (n + 1) + (end - at)[use]), n + 1)
        power, inverse = (np.multiply.accumulate(np.append(np.uint64(1), np.full(n, b, np.uint64))) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hash * power[:n])])
        return mix(mix((sums[at + m] - sums[at]) * inverse[at]) + m.astype(np.uint64)), at, m


def _write(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema) as out:
        for b in batches:
            out.write_batch(b)
    return sink.getvalue().to_pybytes()


def _open(payload: bytes) -> Iterator[tuple[pa.RecordBatch, Sentences]]:
    for batch in pa.ipc.open_stream(payload):
        yield batch, Sentences(*buffer(batch.column("text").fill_null("")))


def remove(docs: DataFrame, row: str | None = None, whole: bool = False) -> DataFrame:
    """row (the column of that name as text), doc_id, text without repeated passages, n_sentences, n_removed and
    n_removed_words of every document."""
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.col(row).cast("string") if row else F.lit(None).cast("string")).alias("row"))

    def emit(batch: pa.RecordBatch, texts: pa.Array, counts: list[pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), texts, *counts], ["row", "doc_id", "text", "n_sentences", "n_removed", "n_removed_words"])

    return _removed(picked, emit, _SCHEMA, whole)


def remove_from(docs: DataFrame) -> DataFrame:
    """The documents with their cleaned texts; all other columns stay as they are, whatever their types and names."""
    names, at = docs.columns, docs.columns.index("text")
    picked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *(F.col(f"`{c.replace('`', '``')}`") for c in names)).toDF("doc_id", "text", *(f"c{i}" for i in range(len(names))))

    def emit(batch: pa.RecordBatch, texts: pa.Array, counts: list[pa.Array]) -> pa.RecordBatch:
        own = batch.columns[2:]
        own[at] = texts
        return pa.RecordBatch.from_arrays(own, names)

    return _removed(picked, emit, docs.schema, False)


def _removed(picked: DataFrame, emit: Callable[[pa.RecordBatch, pa.Array, list[pa.Array]], pa.RecordBatch], schema: StructType | str, whole: bool) -> DataFrame:
    """emit(rows, their cleaned texts, counts) for all rows of picked(doc_id, text, ...), which travel with their block."""
    scratch = Scratch(picked.sparkSession, "substring")
    least, most = picked.agg(F.min("doc_id"), F.max("doc_id")).first()
    base, none = (least or 0), (most or 0) - (least or 0) + 1

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def payloads() -> Iterator[bytes]:
            held, size = [], 0
            for batch in slices(batches, 1):
                held.append(batch)
                size += int(sizes(batch.column(1)).sum())
                if size >= BLOCK_BYTES:
                    yield _write(held)
                    held, size = [], 0
            if held:
                yield _write(held)

        fresh()
        yield from block_rows(TaskContext.get().partitionId(), payloads())

    def ranks(batch: pa.RecordBatch) -> np.ndarray:
        ids = batch.column("doc_id")
        return np.where(ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(base).to_numpy() - base, none).astype(np.uint64)

    def gathered(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
        found = [(key, ranks(b)[s.owner[at]]) for b, s in _open(payload) for key, at, _ in [s.spans(whole)]]
        return np.concatenate([k for k, _ in found]), np.concatenate([r for _, r in found])

    def keys(payload: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
        key, rank = gathered(payload)
        order = np.lexsort((rank, key))
        first = np.flatnonzero(np.append(True, np.diff(key[order]) != 0)) if len(key) else np.zeros(0, np.int64)
        return [(key[order][first], rank[order][first])]

    answer = Answer(lambda kind, rank, first: np.minimum.reduceat(rank, first), lambda kind, least_rank, own: (least_rank == own).astype(np.uint64))

    def finish(block: int, payload: bytes, said: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        (known, least_rank), = keys(payload)
        for batch, s in _open(payload):
            key, at, m = s.spans(whole)
            place = np.searchsorted(known, key)
            rank, doc = ranks(batch)[s.owner[at]], s.owner[at]
            held = (said[0][place] == 1) & (rank == least_rank[place]) if len(place) else np.zeros(0, bool)
            order = np.lexsort((at, doc, place))
            again = np.append(False, (np.diff(place[order]) == 0) & (np.diff(doc[order]) == 0)) if len(place) else np.zeros(0, bool)
            held[order] &= ~again
            gone = np.zeros(len(s.hash) + 1, np.int64)
            np.add.at(gone, at[~held], 1)
            np.add.at(gone, at[~held] + m[~held], -1)
            yield cleaned(batch, s, np.cumsum(gone)[:-1] > 0)

    def cleaned(batch: pa.RecordBatch, s: Sentences, gone: np.ndarray) -> pa.RecordBatch:
        texts, n = batch.column("text").to_pylist(), batch.num_rows
        data, ends = buffer(batch.column("text").fill_null(""))
        drop = np.zeros(len(data) + 1, np.int64)
        np.add.at(drop, s.starts[gone], 1)
        np.add.at(drop, s.stops[gone], -1)
        keep = np.cumsum(drop)[:-1] == 0
        for i in np.unique(s.owner[gone]).tolist():
            own = slice(ends[i], ends[i + 1])
            texts[i] = data[own][keep[own]].tobytes().decode()
        count = lambda w=None: pa.array(np.bincount(s.owner[gone] if w is not None else s.owner, w, n).astype(np.int64))
        return emit(batch, pa.array(texts, pa.string()), [count(), count(np.ones(int(gone.sum()))), count(s.words[gone])])

    made = scratch.write(picked.mapInArrow(blocks, BLOCKS), "blocks", "none")
    replies, _ = exchange(made, keys, answer, scratch, "replies")
    out = scratch.write(answers(made, replies, 1, finish, schema), "cleaned")
    scratch.drop("blocks")
    scratch.drop("replies-1")
    return out

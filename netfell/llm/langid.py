"""Operator 3: language identification by prediction by partial matching.

Each language has a byte context tree of variable order: counts of each byte after each context of up to ORDER bytes.
A byte's probability is its share in the longest context that has been seen, where a context also gives its number of
different followers to an escape to the next shorter one (method C), and at the end all 256 bytes are alike. The
statistics are frozen after training, so a text's code length in a language is a sum over its grams. The trees are
sorted arrays of what training has seen, broadcast once; their size is that of the sample's different grams, whatever
the number of languages and scripts. The language with the shortest code wins.

Training reads a sample of whole texts whose expected number per language is the parameter ``sample_docs``, or fewer
where they would hold more than SAMPLE_BYTES; a row's part in it hangs on a hash of its doc_id alone. Every text is
scored whole.

``predict`` names a learned language for every text with a letter. ``keep`` also takes an unknown language into
account, whose bytes are all alike at 8 bits each: a text that no learned language describes better than that, but for
MARGIN bits, goes, as do texts without a letter and near ties.

Null text and text without a letter give ``und`` with score 0; so does every text where nothing could be learned.
Languages that tie go to the first in alphabetical order. Repeated rows are scored each for itself; columns besides
doc_id, text and, for training, lang are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netfell.llm.arrow import buffer, sizes, slices
from netfell.llm.workers import fresh

ORDER = 3
#: Whole texts, and bytes of text, that are learned from per language: expected numbers at most.
SAMPLE_DOCS, SAMPLE_BYTES = 500, 4 << 20
#: A text is in no learned language if every language's code is longer by so many bits than bytes drawn all alike.
MARGIN = 32.0
#: Every text begins as if after so many line ends.
PAD = 10
#: Bytes scored at a time.
_STEP = 1 << 19


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    """Whether the crc32 of doc_id as text leaves ``fold``; a null doc_id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def _padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values' bytes, each after ORDER pads; and where each value begins, with the end of the last."""
    data, ends = buffer(column)
    starts = ends + ORDER * np.arange(len(ends))
    out = np.full(len(data) + ORDER * (len(ends) - 1), PAD, np.uint8)
    keep = np.ones(len(out), bool)
    keep[(starts[:-1, None] + np.arange(ORDER)).ravel()] = False
    out[keep] = data
    return out, starts


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram (ORDER + 1 bytes as one number) and count over the texts of docs(lang, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        for batch in slices(batches, 1):
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in sorted(set(langs)):
                data, starts = _padded(batch.column(1).filter(pa.array(langs == lang)))
                data = data.astype(np.uint32)
                gram = reduce(lambda a, k: a << 8 | data[k : len(data) - ORDER + k], range(ORDER + 1), np.uint32(0))
                inside = np.ones(len(gram), bool)
                inside[(starts[1:-1, None] - 1 - np.arange(ORDER)).ravel()] = False
                found, n = np.unique(gram[inside], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    counted = docs.mapInArrow(count, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Grams and their counts for each language, from about ``sample_docs`` texts of each."""
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sums = known.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes")).collect()  # a row for each language
    share = {r["lang"]: min(sample_docs / r["n"], SAMPLE_BYTES / max(r["bytes"], 1)) for r in sums}
    if not share:
        return {}
    shares = F.create_map(*(F.lit(x) for pair in sorted(share.items()) for x in pair))
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.try_element_at(shares, "lang") * (1 << 20)
    rows = gram_counts(known.where(drawn).select("lang", "text")).toPandas()  # bounded by the sample's bytes
    return {str(lang): (own["gram"].to_numpy(), own["n"].to_numpy()) for lang, own in rows.groupby("lang")}


class Model:
    """The languages' context trees, sparse: for each language and order the grams that training has seen with the code
    length of their last byte, and the contexts seen with that of an escape to the next shorter one."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        self.trees = [[self._order(*counts[lang], k) for k in range(ORDER + 1)] for lang in self.langs]

    @staticmethod
    def _order(gram: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Grams of k bytes and one more (the latest lowest) with code lengths; contexts of k bytes with escapes'."""
        grams, back = np.unique(gram & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
        own = np.bincount(back, n, len(grams))
        contexts, of, kinds = np.unique(grams >> 8, return_inverse=True, return_counts=True)
        total = np.bincount(of, own, len(contexts))
        bits = -np.log2(own / (total + kinds)[of]), -np.log2(kinds / (total + kinds))
        return grams.astype(np.uint32), bits[0].astype(np.float32), contexts.astype(np.uint32), bits[1].astype(np.float32)

    @staticmethod
    def _find(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(known, wanted), max(len(known) - 1, 0))
        return at, known[at] == wanted if len(known) else np.zeros(len(wanted), bool)

    def gram_bits(self, tree: list, gram: np.ndarray) -> np.ndarray:
        """Code length in one language of the last byte of each gram of ORDER + 1 bytes."""
        cost, open_ = np.zeros(len(gram)), np.arange(len(gram))
        for k in range(ORDER, -1, -1):
            grams, bits, contexts, escape = tree[k]
            own = gram[open_] & np.uint32((1 << 8 * (k + 1)) - 1)
            at, seen = self._find(grams, own)
            cost[open_[seen]] += bits[at[seen]]
            open_, own = open_[~seen], own[~seen]
            at, seen = self._find(contexts, own >> np.uint32(8))
            cost[open_[seen]] += escape[at[seen]]
        cost[open_] += 8
        return cost

    def bits(self, column: pa.Array) -> np.ndarray:
        """Code length of each value in each language, in bits."""
        data, starts = _padded(column)
        out = np.zeros((len(column), len(self.langs)))
        first = starts[:-1] + ORDER
        for a in range(0, len(data), _STEP):
            own = data[max(0, a - ORDER) : a + _STEP].astype(np.uint32)
            skip = a - max(0, a - ORDER)
            gram = own[skip:].copy()
            for k in range(1, min(ORDER, len(own) - 1) + 1):
                gram[max(0, k - skip) :] |= own[max(0, skip - k) : len(own) - k] << np.uint32(8 * k)
            place = np.arange(a, a + len(gram))
            owner = np.searchsorted(starts, place, side="right") - 1
            inside = place >= first[owner]
            owner, (known, back) = owner[inside], np.unique(gram[inside], return_inverse=True)
            begins = np.flatnonzero(np.diff(owner, prepend=-1))
            for i, tree in enumerate(self.trees if len(begins) else ()):
                out[owner[begins], i] += np.add.reduceat(self.gram_bits(tree, known)[back], begins)
        return out


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score (the winner's share of the probability among the languages) and bits_per_byte of every
    text of docs(doc_id, text)."""
    spark = docs.sparkSession
    schema = "doc_id long, lang_pred string, score double, bits_per_byte double"
    picked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    shared = spark.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        own = shared.value
        for batch in slices(batches, 1):
            letters = batch.column(2).to_numpy(zero_copy_only=False)
            name, score = np.full(len(batch), "und", object), np.zeros(len(batch))
            rate = np.full(len(batch), np.nan)
            if own is not None and own.langs:
                bits = own.bits(batch.column(1).fill_null(""))
                best = bits.argmin(axis=1)
                share = 1 / np.exp2(np.minimum(bits.min(axis=1)[:, None] - bits, 0.0)).sum(axis=1)
                name = np.where(letters, np.array(own.langs, object)[best], name)
                score = np.where(letters, share, 0.0)
                rate = bits.min(axis=1) / np.maximum(sizes(batch.column(1)), 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(name, pa.string()), pa.array(score), pa.array(rate, mask=~letters | np.isnan(rate))], ["doc_id", "lang_pred", "score", "bits_per_byte"]
            )

    return picked.mapInArrow(run, schema)


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model | None:
    counts = learn(docs, sample_docs)
    return Model(counts) if counts else None


def identify(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Learn from all folds but 0 and predict the language of every text."""
    model = train(docs.where(~held_out(F.col("doc_id"))), sample_docs)
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def keep(docs: DataFrame, model: Model | None, least_score: float = 0.5) -> DataFrame:
    """The rows, with all columns, whose text is in a language that the model gives at least this score among the learned
    ones, and that describes the text better than bytes drawn all alike, but for MARGIN bits. Without a model, none."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    text, letters = docs.columns.index("text"), f"letters_{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        own = shared.value
        for batch in slices(batches, text) if own is not None else ():
            bits = own.bits(batch.column(text).fill_null(""))
            best = bits.min(axis=1)
            share = 1 / np.exp2(np.minimum(best[:, None] - bits, 0.0)).sum(axis=1)
            use = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False) & (share >= least_score)
            use &= best <= 8.0 * sizes(batch.column(text)) + MARGIN
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], batch.schema.names[:-1]).filter(pa.array(use))

    marked = docs.withColumn(letters, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return marked.mapInArrow(run, docs.schema)

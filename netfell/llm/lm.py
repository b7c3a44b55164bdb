"""Operator 7: language-model scores by deleted interpolation.

Maximum-likelihood estimates of bigrams, words and a uniform last resort are mixed with weights that hang on how often
the context was seen (a bucket for each power of two). The weights are learned by expectation-maximisation on counts
from which each training token has been left out in turn, summed in a histogram of bounded size over all training
tokens. Counts cover all training documents; they travel by ``blockexchange``, once per distinct key and block.

Tokens are the words of ``words`` and one end a document, which is also the context of its first word. Words are told
apart by 64-bit numbers, bigrams by 56-bit ones. Null or empty text is one end. A null doc_id is not held out. Without
training documents every probability is the uniform one. Repeated rows are scored each for itself, and counted as often
as they stand there; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netfell.llm.arrow import buffer, slices
from netfell.llm.blockexchange import BLOCKS, Answer, answers, block_rows, exchange, pack_parts, pack_small, squeeze, unpack_parts, unpack_small, unsqueeze
from netfell.llm.langid import held_out
from netfell.llm.words import mix, words
from netfell.llm.workers import fresh
from netfell.scratch import Scratch

#: Text of a block.
BLOCK_BYTES = 8 << 20
END = np.uint64(0x656E64)
#: The last context bucket, and how finely log ratios are binned for learning the weights.
LAST_BUCKET, BINS = 40, 8
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def token_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of documents: ids, which are held out, tokens of each, the block's words and each token's place in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        yield from block_rows(TaskContext.get().partitionId(), payloads(batches))

    def payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        held, size = [], 0
        for batch in slices(batches, 1):
            data, ends = buffer(batch.column(1).fill_null(""))
            numbers, n = words(data, ends)
            at = np.cumsum(n)
            tokens = np.insert(numbers, at, END)
            ids = batch.column(0)
            held.append((ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False), n + 1, tokens))
            size += len(data)
            if size >= BLOCK_BYTES:
                yield payload(held)
                held, size = [], 0
        if held:
            yield payload(held)

    def payload(held: list) -> bytes:
        ids, valid, out, n, tokens = (np.concatenate(x) for x in zip(*held, strict=True))
        known, place = np.unique(tokens, return_inverse=True)
        return pack_parts([ids.astype("<i8").tobytes(), valid.astype(np.uint8).tobytes(), out.astype(np.uint8).tobytes(), n.astype("<u4").tobytes(), known.astype("<u8").tobytes(), place.astype("<u4").tobytes()])

    picked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out(F.col("doc_id"), 7, 2))
    return picked.mapInArrow(run, BLOCKS)


_KINDS = ("<i8", np.uint8, np.uint8, "<u4", "<u8", "<u4")


def _open(payload: bytes) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x, kind in zip(unpack_parts(payload), _KINDS, strict=True)]


def _bigrams(known: np.ndarray, place: np.ndarray) -> np.ndarray:
    end = int(np.searchsorted(known, END))
    before = np.concatenate([[end], place[:-1]])
    return mix(known[before] * np.uint64(0xD6E8FEB86659FD93) + known[place]) >> np.uint64(8) << np.uint64(8)


def _keys(payload: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
    _, _, out, n, known, place = _open(payload)
    trains = np.repeat(out == 0, n)
    seen = np.bincount(place[trains], minlength=len(known))
    pairs, back = np.unique(_bigrams(known, place), return_inverse=True)
    return [(known, seen), (pairs, np.bincount(back[trains], minlength=len(pairs)))]


_TOTALS = Answer(
    lambda kind, numbers, first: np.add.reduceat(numbers, first),
    sums=lambda kind, totals: {} if kind else {"tokens": float(totals.sum()), "words": float((totals > 0).sum())},
)


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for a context not seen, else one more than its count's power of two."""
    return np.minimum(np.frexp(context.astype(float))[1], LAST_BUCKET)


def _left_out(word: np.ndarray, context: np.ndarray, pair: np.ndarray, n: float, v: float) -> tuple[np.ndarray, np.ndarray]:
    """Training tokens, each left out of the counts, as bins and how many fall in each: bucket, then the logs of word
    and bigram estimate over the uniform one (bin 0: estimate 0)."""

    def binned(share: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return np.where(share > 0, np.clip(np.round(np.log(share * (v + 1)) * BINS) + 512, 1, 1023), 0).astype(np.int64)

    word, context, pair = word.astype(float) - 1, context.astype(float) - 1, pair.astype(float) - 1
    code = bucket(context).astype(np.int64) << 20 | binned(word / max(n - 1, 1)) << 10 | binned(pair / np.maximum(context, 1))
    return np.unique(code, return_counts=True)


def learn_weights(code: np.ndarray, count: np.ndarray, rounds: int = 60) -> np.ndarray:
    """For each bucket the weights of bigram, word and uniform estimate."""
    ratio = lambda x: np.where(x > 0, np.exp((x - 512.0) / BINS), 0.0)
    of = code >> 20
    share = np.stack([ratio(code & 1023), ratio(code >> 10 & 1023), np.ones(len(code))], axis=1)
    weights = np.full((LAST_BUCKET + 1, 3), 1 / 3)
    weights[0] = [0, 0.5, 0.5]
    prior = np.where(weights > 0, 0.5, 0.0)
    for _ in range(rounds):
        part = weights[of] * share
        part *= (count / part.sum(axis=1))[:, None]
        total = prior.copy()
        np.add.at(total, of, part)
        weights = total / total.sum(axis=1, keepdims=True)
    return weights


_JOINED = pa.schema([("payload", pa.binary()), ("code", pa.list_(pa.int64())), ("n", pa.list_(pa.int64()))])


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    scratch = Scratch(docs.sparkSession, "lm")
    blocks = scratch.write(token_blocks(docs), "blocks", "none")
    replies, sums = exchange(blocks, _keys, _TOTALS, scratch, "replies")
    n, v = sums.get("tokens", 0.0), sums.get("words", 0.0)

    def finish(block: int, payload: bytes, said: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        ids, valid, out, lengths, known, place = _open(payload)
        word, trains = said[0][place], np.repeat(out == 0, lengths)
        context = np.concatenate([said[0][np.searchsorted(known, END)][None], word[:-1]])
        pair = said[1][np.unique(_bigrams(known, place), return_inverse=True)[1]]
        code, count = _left_out(word[trains], context[trains], pair[trains], n, v)
        parts = [ids.tobytes(), valid.tobytes(), out.tobytes(), lengths.tobytes(), place.tobytes(), pack_small(said[0]), pack_small(pair), np.searchsorted(known, END).astype("<u4").tobytes()]
        yield pa.RecordBatch.from_pydict({"payload": [squeeze(pack_parts(parts))], "code": [code.tolist()], "n": [count.tolist()]}, schema=_JOINED)

    joined = scratch.write(answers(blocks, replies, 2, finish, "payload binary, code array<long>, n array<long>"), "joined", "none")
    scratch.drop("blocks")
    scratch.drop("replies-1")
    binned = joined.select(F.explode(F.arrays_zip("code", "n")).alias("x")).groupBy("x.code").agg(F.sum("x.n").alias("n")).toPandas()  # bins, not tokens
    weights = learn_weights(binned["code"].to_numpy(np.int64), binned["n"].to_numpy(np.float64))
    if not n:
        weights[:] = [0, 0, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(0):
                yield _scores(unpack_parts(unsqueeze(payload.as_py())), n, v, weights)

    return scratch.write(joined.select("payload").mapInArrow(run, _SCORES), "scores")


def _scores(parts: list[bytes], n: float, v: float, weights: np.ndarray) -> pa.RecordBatch:
    ids, valid, out, lengths, place = (np.frombuffer(x, kind) for x, kind in zip(parts, ("<i8", np.uint8, np.uint8, "<u4", "<u4"), strict=False))
    seen, pair, end = unpack_small(parts[5]), unpack_small(parts[6]).astype(float), int(np.frombuffer(parts[7], "<u4")[0])
    word = seen[place].astype(float)
    context = np.concatenate([[float(seen[end])], word[:-1]])
    mixed = weights[bucket(context)]
    p = mixed[:, 0] * pair / np.maximum(context, 1) + mixed[:, 1] * word / max(n, 1) + mixed[:, 2] / (v + 1)
    first = np.cumsum(lengths.astype(np.int64)) - lengths
    total = lambda x: np.add.reduceat(x, first)
    columns = [pa.array(ids, mask=valid == 0), pa.array(out != 0), pa.array(lengths.astype(np.int64)), pa.array(total((word > 0).astype(np.int64)))]
    columns += [pa.array(np.full(len(ids), int(n))), pa.array(total(np.log10((word + 1) / (n + (v + 1))))), pa.array(total(np.log10(p)))]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

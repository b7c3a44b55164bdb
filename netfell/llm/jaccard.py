"""Operator 5: documents whose word shingles are alike, by a parity-sketch join.

A document's set is its distinct shingles of WIDTH words (all words as one if there are fewer). Two sets a and b with
100 * |a & b| >= PERCENT * |a | b| differ in at most d(|a|, |b|) shingles, so when the range of shingle hashes is cut
into more than d parts, some part is the same in both. Each part is sketched as the exclusive-or of its shingles'
hashes; sets whose sizes fall in one band or two neighbouring bands (all that can be alike do) use the same parts, and
join on equal sketches. Parts with fewer than two shingles say little and are left out where the parts with more are
themselves more than d; a set with too few of those also joins on its small parts, and one with too few parts of any
kind on its single shingles, so no link can be missed. As all but d of a set's parts, small ones included, are in any set
alike, a set that shares fewer of them with the others than that does not join in that band at all: common passages
bring no candidates. Candidates are verified: first the Hamming distance of sketches
of single bits, which cannot exceed the number of differing shingles, then the sets themselves.

Equal sets are one node from the start. Sketches meet by ``blockexchange``, so that a sketch found in many documents
costs one entry a block. Candidates come in rounds: each node with the least node it shares a sketch with; then, in
each sketch, with its nearest by bit sketches in another component; then every pair of a sketch that is still in
different components and that the bit sketches don't rule out. Only such pairs leave a task; pairs within a component
are not looked at again, so a large group of near copies costs a few pairs a member.

Null or empty text has an empty set, linked with nothing. Repeated rows are equal sets. component_id is the least
doc_id of the component; rows with a null doc_id have no say in it. Hashes have 64 bits. Columns besides doc_id and
text are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netfell.llm.arrow import buffer, sizes, slices
from netfell.llm.blockexchange import BLOCKS, Answer, answers, block_rows, exchange
from netfell.llm.blockpairs import block_pairs, groups
from netfell.llm.words import mix, words
from netfell.llm.workers import fresh
from netfell.operators.components import component_labels
from netfell.scratch import Scratch

WIDTH, PERCENT = 4, 85
BLOCK_BYTES = 4 << 20
#: Members of a sketch that are compared at a time.
BLOCK = 2048
_NODES = "doc_id long, n_shingles long, node long, first_id long, keys array<long>, shingles binary, sketch binary"
_NODE = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("first_id", pa.int64()), ("keys", pa.list_(pa.int64())), ("shingles", pa.binary()), ("sketch", pa.binary())])
_A, _B, _LIGHT, _SINGLE = np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3), np.uint64(0x6C69676874), np.uint64(0x73696E67)
_ONE = np.uint64(1)


def shingle_sets(numbers: np.ndarray, n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, ascending within a text, and how many each has; from all texts' words."""
    ends = np.cumsum(n)
    out = np.full(max(0, len(numbers) - width + 1), width, np.uint64)
    for i in range(width):
        out = mix(out * _A + numbers[i : len(numbers) - width + 1 + i])
    owner = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(out)) + width <= ends[owner[: len(out)]] if len(out) else np.zeros(0, bool)
    out, count = out[inside], np.maximum(n - width + 1, 0)
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):  # all words as one
        whole = []
        for i in short.tolist():
            x = np.full(1, n[i], np.uint64)
            for w in numbers[ends[i] - n[i] : ends[i]]:
                x = mix(x * _A + w)
            whole.append(x)
        out = np.insert(out, np.cumsum(count)[short], np.concatenate(whole))
        count[short] = 1
    at = 0
    for end in np.cumsum(count).tolist():
        out[at:end].sort()
        at = end
    owner = np.repeat(np.arange(len(n)), count)
    first = np.concatenate([[True], (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])]) if len(out) else np.zeros(0, bool)
    return out[first], np.bincount(owner[first], minlength=len(n))


class Bands:
    """Size bands such that sets that can be alike are in one band or in neighbouring ones."""

    def __init__(self, percent: int):
        self.percent, self.starts = percent, [1]

    def band(self, n: int) -> int:
        while self.starts[-1] <= n:
            self.starts.append(self.starts[-1] * 100 // self.percent + 1)
        return int(np.searchsorted(self.starts, n, side="right")) - 1

    def most(self, a: int, b: int) -> int:
        """Most shingles in which alike sets of these sizes differ."""
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def parts(self, group: int) -> tuple[int, int]:
        """For pairs whose smaller set is in this band: how many parts, and in how many they can differ."""
        self.band(self.starts[-1])
        while len(self.starts) < group + 2:
            self.band(self.starts[-1])
        top = self.starts[group + 1] - 1
        d = self.most(top, top * 100 // self.percent)
        return (d + 2 + d // 4 if d else 1), d


#: Kinds of join keys: of a part that says enough, of a part that is only counted, of a single shingle.
JOINS, COUNTS, ALONE = 0, 1, 2


def _sketches(sets: np.ndarray, size: np.ndarray, group: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The join keys of sets that are not empty, each for the group given for it, whose they are, and their kinds; and
    for each set how many of its parts a set alike must share."""
    known, back = np.unique(group, return_inverse=True)
    k, d = (np.array(x, np.int64)[back] for x in zip(*(bands.parts(int(g)) for g in known), strict=True))
    owner = np.repeat(np.arange(len(size)), size)
    apart = group.astype(np.uint64) * _B
    part = (sets >> np.uint64(32)) * k.astype(np.uint64)[owner] >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (owner[1:] != owner[:-1])]))
    n = np.diff(np.append(first, len(sets)))
    own = owner[first]
    key = mix(mix(np.bitwise_xor.reduceat(mix(sets ^ _B), first)) + part[first] * _A + apart[own])
    heavy, parts = n > 1, np.bincount(own, minlength=len(size))
    weak = np.bincount(own[heavy], minlength=len(size)) <= d
    alone = (parts <= d)[owner]
    key = np.where(heavy, key, mix(key ^ _LIGHT))
    keys = [key, mix(mix(sets[alone] ^ _SINGLE) + apart[owner[alone]])]
    kinds = [np.where(heavy | weak[own], JOINS, COUNTS), np.full(int(alone.sum()), ALONE)]
    return np.concatenate(keys), np.concatenate([own, owner[alone]]), np.concatenate(kinds), np.maximum(parts - d, 0)


def sketch_keys(sets: np.ndarray, size: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The join keys of sets (their hashes in a row, ascending in each), for the groups of their own band and the one
    below; whose they are, in ascending order, as twice the set, and one more in the lower group; their kinds; and how
    many parts a set alike shares in each group."""
    if not len(size):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes, back = np.unique(size, return_inverse=True)
    band = np.array([bands.band(int(n)) for n in sizes])[back]
    need = np.zeros(2 * len(size), np.int64)
    keys, owner, kinds, need[::2] = _sketches(sets, size, band, bands)
    owner, upper = 2 * owner, np.flatnonzero(band > 0)
    if len(upper):
        use = np.repeat(band > 0, size)
        more, whose, kind, need[2 * upper + 1] = _sketches(sets[use], size[upper], band[upper] - 1, bands)
        keys, owner, kinds = np.concatenate([keys, more]), np.concatenate([owner, 2 * upper[whose] + 1]), np.concatenate([kinds, kind])
    order = np.argsort(owner, kind="stable")
    return keys[order], owner[order], kinds[order], need


def bit_sketch(own: np.ndarray, bits: int) -> np.ndarray:
    """A set's parity in each of ``bits`` (a power of two) buckets of hashes, as bytes."""
    return np.packbits((np.bincount((mix(own ^ _A) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8))


def sketch_bits(size: int) -> int:
    """Bits of a set's sketch: a power of two between its size and twice that, 64 at least."""
    return max(64, 1 << (size - 1).bit_length())


def folded(sketch: np.ndarray, bits: int) -> np.ndarray:
    """The sketch as it would be with fewer bits."""
    while len(sketch) * 8 > bits:
        half = len(sketch) // 2
        sketch = sketch[:half] ^ sketch[half:]
    return sketch


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets are linked."""
    small, large = sorted((len(a), len(b)))
    if not small or 100 * small < percent * large:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def near_pairs(t: pa.Table, percent: int, nearest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Members of one sketch, in different components, whose bit sketches do not rule a link out: all pairs, or for each
    member the pair with the least Hamming distance."""
    a, b = t.column("a")[0].as_py(), t.column("b")[0].as_py()
    block, size, part = (t.column(c).to_numpy() for c in ("block", "size", "c"))
    raw = [np.frombuffer(x, np.uint8) for x in t.column("sketch").to_pylist()]
    bits = min(map(len, raw)) * 8
    x = np.stack([folded(r, bits) for r in raw]).view(np.uint64)
    left, right = np.flatnonzero(block == a), np.flatnonzero(block == b)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(left), 64):
        i = left[at : at + 64]
        far = np.bitwise_count(x[i][:, None] ^ x[right][None]).sum(axis=2, dtype=np.int64)
        both = size[i][:, None] + size[right][None]
        ok = (far <= (100 - percent) * both // (100 + percent)) & (part[i][:, None] != part[right][None])
        ok &= 100 * np.minimum(size[i][:, None], size[right][None]) >= percent * np.maximum(size[i][:, None], size[right][None])
        if nearest:
            best = np.where(ok, far, np.iinfo(np.int64).max).argmin(axis=1)
            use = ok[np.arange(len(i)), best]
            found.append((i[use], right[best[use]]))
        else:
            p, q = np.nonzero(ok & (i[:, None] < right[None]) if a == b else ok)
            found.append((i[p], right[q]))
    return np.concatenate([p for p, _ in found]), np.concatenate([q for _, q in found])


class _Block:
    """One block's documents, their sets, and the keys of its different sets."""

    def __init__(self, payload: bytes, base: int, none: int, width: int, percent: int):
        ids, valid, sets, size = [], [], [], []
        for batch in pa.ipc.open_stream(payload):
            own, count = shingle_sets(*words(*buffer(batch.column("text").fill_null(""))), width)
            sets.append(own)
            size.append(count)
            ids.append(batch.column("doc_id").fill_null(base).to_numpy())
            valid.append(batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False))
        self.ids, self.valid, self.size = np.concatenate(ids), np.concatenate(valid), np.concatenate(size)
        self.flat, self.ends = np.concatenate(sets), np.cumsum(self.size)
        self.rank = np.where(self.valid, self.ids - base, none).astype(np.uint64)
        some = np.flatnonzero(self.size)
        sums = np.zeros(len(self.size), np.uint64)
        if len(some):
            sums[some] = np.add.reduceat(mix(self.flat ^ _LIGHT), (self.ends - self.size)[some])
        self.node = mix(sums + self.size.astype(np.uint64) * _A)
        order = np.lexsort((self.rank, self.node))
        order = order[self.size[order] > 0]
        self.own = order[np.concatenate([[True], self.node[order[1:]] != self.node[order[:-1]]])] if len(order) else order
        picked = np.sort(self.own)  # the first of each different set
        use = np.zeros(len(self.size), bool)
        use[picked] = True
        self.keys, self.slot, self.kind, self.need = sketch_keys(self.flat[np.repeat(use, self.size)], self.size[picked], Bands(percent))
        self.whose = picked[self.slot // 2]

    def joining(self, shared: np.ndarray) -> np.ndarray:
        """Which keys the sets join on, given which keys other sets have too: none of a set's keys in a group where it
        shares fewer parts than with any set alike."""
        counted = np.bincount(self.slot[shared & (self.kind != ALONE)], minlength=len(self.need))
        return shared & (self.kind != COUNTS) & (counted >= self.need)[self.slot]

    def set_of(self, i: int) -> np.ndarray:
        return self.flat[self.ends[i] - self.size[i] : self.ends[i]]


def _payload(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema) as out:
        for b in batches:
            out.write_batch(b)
    return sink.getvalue().to_pybytes()


def text_blocks(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def payloads() -> Iterator[bytes]:
            held, size = [], 0
            for batch in slices(batches, 1):
                held.append(batch)
                size += int(sizes(batch.column(1)).sum())
                if size >= BLOCK_BYTES:
                    yield _payload(held)
                    held, size = [], 0
            if held:
                yield _payload(held)

        fresh()
        yield from block_rows(TaskContext.get().partitionId(), payloads())

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, BLOCKS)


def nodes(docs: DataFrame, scratch: Scratch, width: int, percent: int) -> DataFrame:
    """A row for each document: doc_id, n_shingles, node (its set), first_id (the least doc_id with that set), and for
    one document of each set that shares a sketch with another set: the shared sketches' keys, and the set."""
    least, most = docs.agg(F.min(F.col("doc_id").cast("long")), F.max(F.col("doc_id").cast("long"))).first()
    base, none = (least or 0), (most or 0) - (least or 0) + 1
    blocks = scratch.write(text_blocks(docs), "blocks", "none")

    def distinct_keys(b: _Block) -> tuple[np.ndarray, np.ndarray]:
        """The block's keys and, for each, the hash of the set that alone has it, or 0."""
        order = np.argsort(b.keys, kind="stable")
        flat, mark = b.keys[order], np.maximum(b.node, _ONE)[b.whose[order]]
        first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
        return flat[first], np.where(np.diff(np.append(first, len(flat))) > 1, 0, mark[first])

    def keys_of(payload: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
        b = _Block(payload, base, none, width, percent)
        return [(b.node[b.own], b.rank[b.own]), distinct_keys(b)]

    def merge(kind: int, number: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The least rank of a set; the set that alone has a sketch, or 0."""
        low = np.minimum.reduceat(number, first)
        return np.where(low == np.maximum.reduceat(number, first), low, 0) if kind else low

    answer = Answer(merge, lambda kind, merged, own: (merged == 0).astype(np.uint64) if kind else merged)

    def finish(block: int, payload: bytes, said: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        b = _Block(payload, base, none, width, percent)
        known, _ = distinct_keys(b)
        least_rank = np.full(len(b.ids), none, np.uint64)
        if len(b.own):
            at = np.minimum(np.searchsorted(b.node[b.own], b.node), len(b.own) - 1)
            least_rank = np.where(b.size > 0, said[0][at], b.rank)
        keys: list[list[int]] = [[] for _ in b.ids]
        sets, bits = [b""] * len(b.ids), [b""] * len(b.ids)
        shared = b.joining(said[1][np.searchsorted(known, b.keys)] == 1) if len(known) else np.zeros(0, bool)
        shared = np.flatnonzero(shared & (b.rank == least_rank)[b.whose])
        owners, first = np.unique(b.whose[shared], return_index=True)
        for i, some in zip(owners.tolist(), np.split(shared, first[1:]), strict=False):
            keys[i] = np.unique(b.keys[some]).view(np.int64).tolist()
            sets[i] = b.set_of(i).tobytes()
            bits[i] = bit_sketch(b.set_of(i), sketch_bits(int(b.size[i]))).tobytes()
        first_id = pa.array(least_rank.astype(np.int64) + base, mask=least_rank == none)
        for a in range(0, len(b.ids), 2000):
            z = slice(a, a + 2000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(b.ids[z], mask=~b.valid[z]), pa.array(b.size[z], pa.int64()), pa.array(b.node[z].view(np.int64)), first_id[z], pa.array(keys[z], pa.list_(pa.int64())), pa.array(sets[z], pa.binary()), pa.array(bits[z], pa.binary())], schema=_NODE
            )

    replies, _ = exchange(blocks, keys_of, answer, scratch, "replies")
    out = scratch.write(answers(blocks, replies, 2, finish, _NODES), "nodes")
    scratch.drop("blocks")
    scratch.drop("replies-1")
    return out


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of nodes whose sets (node, shingles) are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            a, b = (batch.column(i).to_pylist() for i in (2, 3))
            yes = [alike(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), percent) for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(yes))

    of = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}"))
    return pairs.join(of("u"), "u").join(of("v"), "v").select("u", "v", "su", "sv").mapInArrow(run, "u long, v long")


def candidates(now: DataFrame, sketches: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """Pairs (u, v) that share a sketch, are in different components and may be alike, from now(key, node, c)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches):
            i, j = near_pairs(t, percent, nearest)
            if len(i):
                node = t.column("node").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], ["u", "v"])

    mixed = now.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("key")
    rows = now.join(mixed, "key", "left_semi").join(sketches, "node").select("key", "node", "c", "size", "sketch")
    return block_pairs(rows, "key", "node", BLOCK).mapInArrow(run, "u long, v long").distinct()


def link(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    made = nodes(docs, scratch, width, percent)
    some = made.where(F.length("shingles") > 0)
    sets, sketches = some.select("node", "shingles"), some.select("node", F.col("n_shingles").alias("size"), "sketch")
    shared = scratch.write(some.select("node", F.explode("keys").alias("key")).distinct(), "shared")
    leaders = shared.groupBy("key").agg(F.min("node").alias("v"))
    led = shared.join(leaders, "key").where("node <> v").groupBy(F.col("node").alias("u")).agg(F.min("v").alias("v"))
    links = scratch.write(verified(led, sets, percent), "links")
    for name in ("nearest", "all"):
        labels = component_labels(links, scratch, f"before-{name}")
        now = shared.join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c"))
        pairs = scratch.write(candidates(now, sketches, percent, name == "nearest"), f"pairs-{name}")
        links = scratch.write(links.unionAll(verified(pairs, sets, percent)), f"links-{name}")
    labels = component_labels(links, scratch, "components")
    named = labels.join(some.select("node", "first_id").distinct(), "node")
    least_id = named.groupBy("component").agg(F.min("first_id").alias("least_id"))
    merged = scratch.write(labels.join(least_id, "component").select("node", "least_id"), "merged")
    out = made.select("doc_id", "n_shingles", "node", "first_id").join(merged, "node", "left")
    linked = scratch.write(out.select("doc_id", "n_shingles", F.coalesce("least_id", "first_id").alias("component_id")), "linked")
    scratch.drop_all_but("linked")
    return linked


def one_of_each(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The documents without all but one of each group: the one with the least doc_id stays, and of repeated rows one.

    Rows that share a doc_id and differ in text stay or go together; so do rows with a null doc_id. Of those that share
    both, the one with the least hash of its columns (maps aside) stays."""
    kept_id, place = (f"{c}_{uuid.uuid4().hex}" for c in ("kept", "nth"))
    kept = link(docs, width, percent).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(kept_id)).distinct()
    rest = docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(kept_id)), "left_semi")
    hashed = [f"`{f.name}`" for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString() and "`" not in f.name]
    nth = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.xxhash64(*hashed))
    return rest.withColumn(place, F.row_number().over(nth)).where(F.col(place) == 1).drop(place)

"""Vectors, shingles and passages against brute force."""

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from netfell.llm import blockexchange, capfilter, jaccard, oracle, substring, words
from netfell.tables import table
from tests.compare import rows_of, rows_of_sql
from tests.llm.conftest import SCHEMA, odd_rows, prose

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def least(n, links):
    label = list(range(n))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


# vectors


def vectors():
    rng = np.random.default_rng(0)
    base = rng.normal(size=(12, 64))
    rows = [(i, (base[i % 12] + 0.02 * (i // 12) * rng.normal(size=64)).astype(np.float32).tolist()) for i in range(96)]
    rows += [(500 + i, rows[7][1]) for i in range(4)] + [(7, rows[7][1])]
    return rows + [(900, None), (901, [0.0] * 64), (902, [float("nan")] * 64), (903, [None] * 64), (904, [float("inf")] + [1.0] * 63), (905, []), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (None, rows[3][1])]


@pytest.mark.parametrize("block", [2048, 3])
def test_vectors_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(capfilter, "BLOCK", block)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("own") for c in ("node", "sound", "copies", "label", "filter", "component")})
    sound = {k: np.array(e, float) for k, (_, e) in enumerate(rows) if e and None not in e and np.isfinite(e).all() and any(e)}
    unit = {k: e / np.linalg.norm(e) for k, e in sound.items()}
    links = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    label, n, ids = least(len(rows), links), defaultdict(int), defaultdict(list)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    for k, (i, _) in enumerate(rows):
        if i is not None:
            ids[label[k]].append(i)
    want = sorted((str(i), n[k], min(ids[label[k]], default=None)) for k, (i, _) in enumerate(rows))
    got = capfilter.near_duplicates(df)
    assert sorted((str(r.vec_id), r.n_links, r.component_id) for r in got.collect()) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.where("vec_id IS NOT NULL").collect())
    assert capfilter.near_duplicates(df.limit(0)).count() == 0


def test_vectors_at_the_threshold_are_found():
    """Recall of the filters for pairs of cosine 0.95, the hardest that count."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    codes = capfilter.Codes(64, 50_000)
    sets = []
    for v in (x, y):
        own = defaultdict(set)
        for row, f in zip(*codes.filters(v), strict=True):
            own[row].add(f)
        sets.append(own)
    assert np.mean([bool(sets[0][i] & sets[1][i]) for i in range(len(x))]) >= 0.98


def test_vectors_against_sql(spark, duck):
    assert rows_of(capfilter.near_duplicates(table(spark, SF, "embeddings"))) == rows_of_sql(duck, oracle.cap_filter())


# words


def test_words_are_told_apart():
    import pyarrow as pa

    from netfell.llm.arrow import buffer

    texts = ["", " a B\tb\x0b", "É é", "x" * (words._STEP + 5) + " y", " ", "b"]
    numbers, n = words.words(*buffer(pa.array(texts)))
    split = [WORD.findall(low(t)) for t in texts]
    assert n.tolist() == [len(s) for s in split]
    seen = dict(zip((w for s in split for w in s), numbers.tolist(), strict=True))
    assert len(set(seen.values())) == len(seen) == 6 and numbers[1] == numbers[2] == numbers[-1]


def test_keys_and_numbers_round_trip():
    rng = np.random.default_rng(0)
    for keys in (np.zeros(0, np.uint64), np.array([5], np.uint64), np.unique(rng.integers(0, 1 << 63, 1000).astype(np.uint64) * 2), np.unique(rng.integers(0, 1 << 63, 1000).astype(np.uint64) >> np.uint64(8) << np.uint64(8))):
        assert (blockexchange.unpack_keys(blockexchange.pack_keys(keys)) == keys).all()
    for x in (np.zeros(0, np.uint64), np.array([0, 1, 254, 255, 256, 1 << 40], np.uint64)):
        assert (blockexchange.unpack_small(blockexchange.pack_small(x)) == x).all()


# shingles


def shingle_sets(rows, width):
    out = []
    for r in rows:
        w = WORD.findall(low(r[1]))
        k = min(width, len(w))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    return out


def jaccard_brute(rows, width, percent):
    sets = shingle_sets(rows, width)
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    label, ids = least(len(rows), links), defaultdict(list)
    for k, r in enumerate(rows):
        if r[0] is not None:
            ids[label[k]].append(r[0])
    return sorted((str(r[0]), len(sets[k]), min(ids[label[k]], default=None)) for k, r in enumerate(rows))


def variants():
    """Groups of texts of many lengths whose members differ in a growing number of words."""
    rng, rows = np.random.default_rng(3), odd_rows()
    for g, size in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 25, 30, 40, 60, 90, 150, 300]):
        base = [f"w{g}x{i}" for i in range(size)]
        for m in range(12):
            own = list(base)
            for at in rng.integers(0, size, m * max(1, size // 60)):
                own[at] = f"n{rng.integers(1 << 40)}"
            if m % 4 == 3:
                own = own[: max(1, int(size * 0.9))]
            rows.append((1000 * (g + 1) + m, " ".join(own), "en", "s", 1))
    return rows


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80), (1, 80)])
def test_links_against_all_pairs(spark, odd, width, percent):
    rows = variants()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({c: F.lit("own") for c in ("node", "key", "keys", "shingles", "component_id", "n_shingles", "first_id", "least_id")})
    got = jaccard.link(df, width, percent).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in got) == jaccard_brute(rows, width, percent)


def test_no_sketch_is_missed():
    """Any two alike sets share a key, whatever their sizes."""
    rng, bands = np.random.default_rng(4), None
    for percent in (80, 85):
        bands = jaccard.Bands(percent)
        for n in [*range(1, 40), 60, 100, 333, 1000]:
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            for _ in range(4):
                drop = int(rng.integers(0, max(1, n // 8 + 1)))
                b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, n // 8 + 1))).astype(np.uint64)]))
                if jaccard.alike(a, b, percent):
                    own = [jaccard.sketch_keys(x, np.array([len(x)]), bands)[0] for x in (a, b)]
                    assert np.intersect1d(*own).size


def test_shingles_against_sql(spark, duck, none):
    assert rows_of(jaccard.link(table(spark, SF, "documents"))) == rows_of_sql(duck, oracle.jaccard_join())
    assert jaccard.link(none).count() == 0


def test_one_of_each_stays(spark, odd):
    kept = jaccard.one_of_each(odd, 5, 80)
    assert kept.dtypes == odd.dtypes
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and -5 in ids and not {50, 51, 52} & set(ids) and {60, 61, 62} <= set(ids)


# passages


def sentences(text):
    out, own, start = [], [], None
    found = list(WORD.finditer(text or ""))
    for k, m in enumerate(found):
        start = m.start() if start is None else start
        own.append(low(m[0]))
        after = found[k + 1].start() if k + 1 < len(found) else None
        if m[0][-1] in ".!?" or after is None or "\n" in text[m.end() : after]:
            out.append((tuple(own), start, after if after is not None else len(text)))
            own, start = [], None
    return out


def passages_brute(rows):
    seen, out = {}, {}
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0)):
        doc, text = rows[k][:2]
        s, gone = sentences(text), set()
        for m in range(1, substring.RUN + 1):
            for a in range(len(s) - m + 1):
                key = tuple(x[0] for x in s[a : a + m])
                if sum(map(len, key)) >= (substring.RUN_WORDS if m == substring.RUN else substring.LONG_WORDS):
                    first = seen.setdefault((m, key), doc)
                    own = seen.setdefault((k, m, key), a)
                    if first != doc or own != a:
                        gone |= set(range(a, a + m))
        kept = "".join([(text or "")[: s[0][1]] if s else text or "", *(text[x[1] : x[2]] for j, x in enumerate(s) if j not in gone)])
        out[k] = (str(doc), kept if text is not None else None, len(s), len(gone), sum(len(s[j][0]) for j in gone))
    return sorted(out.values(), key=repr)


def test_passages_against_brute_force(spark, odd, none):
    passage = prose(77, 8)
    rows = odd_rows() + [(2000 + i, f"{prose(300 + i, 4)}\n{passage}\n{prose(400 + i, 3)}" + (" " + passage if i == 2 else ""), "en", "s", 1) for i in range(4)]
    rows += [(3000 + i, f"{prose(500 + i, 3)} {' '.join(['long'] + [f'w{j}' for j in range(50)])}. {prose(600 + i, 3)}", "en", "s", 1) for i in range(2)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumns({c: F.lit("own") for c in ("row", "payload", "n_removed")})
    got = substring.remove(df).drop("row").collect()
    assert sorted(((str(r.doc_id), r.text, r.n_sentences, r.n_removed, r.n_removed_words) for r in got), key=repr) == passages_brute(rows)
    texts = [r.text for r in got if r.doc_id is not None and r.doc_id >= 2000 and r.doc_id < 3000]
    assert sum(passage.split(". ")[3] in t for t in texts) == 1
    assert substring.remove(none).count() == 0
    whole = substring.remove_from(odd)
    assert whole.dtypes == odd.dtypes and rows_of(whole.drop("text")) == rows_of(odd.drop("text"))


def test_passages_against_sql(spark, duck):
    assert rows_of(substring.remove(table(spark, SF, "documents")).drop("row")) == rows_of_sql(duck, oracle.substring_dedup())


def test_whole_passages_of_short_and_middling_sentences(spark):
    lines = [f"l{i}a l{i}b l{i}c l{i}d" for i in range(13)] + ["last one"]  # 54 words
    inside = " ".join(f"m{i}" for i in range(30)) + ". " + " ".join(f"n{i}" for i in range(8)) + "."  # with torn ends, over 50 words
    same = "\n".join(lines)
    rows = [(i, f"{prose(700 + i, 4)}\n{same}\n{prose(710 + i, 3)}", "en", "s", 1) for i in range(3)]
    rows += [(10 + i, f"{prose(720 + i, 2)} Own{i} o1 o2 o3 o4 o5 o6 o7. {inside} p1 p2 p3 p4 p5 p6 end{i}. {prose(730 + i, 2)}", "en", "s", 1) for i in range(3)]
    rows += [(20, "\n".join(lines[:3]), "en", "s", 1), (21, "\n".join(lines[:3]), "en", "s", 1), (30, None, "en", "s", 1), (31, "", "en", "s", 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {r.doc_id: r for r in substring.remove(df, whole=True).collect()}
    assert {d: r.n_removed for d, r in got.items()} == {0: 0, 1: 14, 2: 14, 10: 0, 11: 2, 12: 2, 20: 0, 21: 0, 30: 0, 31: 0}
    assert all(got[d].text == f"{prose(700 + d, 4)}\n{prose(710 + d, 3)}" for d in (1, 2)) and got[0].text == rows[0][1]


def test_sets_whose_hashes_begin_alike_are_linked(spark, monkeypatch):
    rows = [(1, prose(900, 40), "en", "s", 1), (2, prose(900, 40) + " Tail two.", "en", "s", 1)]
    plain = jaccard._Block.__init__

    def alike_marks(self, *args):
        plain(self, *args)
        self.node = self.node & np.uint64((1 << 40) - 1)  # as two different sets whose top 24 bits are equal

    monkeypatch.setattr(jaccard._Block, "__init__", alike_marks)
    df = spark.createDataFrame(rows, SCHEMA)
    found = {}

    def exchange(blocks, keys, answer, scratch, name):
        found["keys"], found["answer"] = keys, answer
        raise StopIteration

    monkeypatch.setattr(jaccard, "exchange", exchange)
    with pytest.raises(StopIteration):
        jaccard.nodes(df, jaccard.Scratch(spark, "marks"), jaccard.WIDTH, jaccard.PERCENT)
    sent = []
    for doc, text, *_ in rows:
        batch = pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([text])], ["doc_id", "text"])
        sent.append(found["keys"](jaccard._payload([batch]))[1])
    common = np.intersect1d(sent[0][0], sent[1][0])
    key, number = (np.concatenate(x) for x in zip(*sent, strict=True))
    order = np.argsort(key, kind="stable")
    said, _ = found["answer"](1, key[order], blockexchange.unpack_small(blockexchange.pack_small(number))[order])
    assert len(common) and set(key[order][said == 1].tolist()) == set(common.tolist())


def test_other_columns_come_through_as_they_are(spark):
    passage = " ".join(f"Word{i} says something of {i} once again here." for i in range(8))
    df = spark.createDataFrame([(i, f"{prose(40 + i, 3)} {passage}") for i in range(3)] + [(7, None)], "doc_id int, text string")
    df = df.select(
        "doc_id", F.expr("timestamp'2024-01-01 00:00:00.123456'").alias("a time"), F.create_map(F.lit(1), F.lit("x")).alias("m"), "text",
        F.lit(float("nan")).alias("od`d"), F.array(F.lit(1.5), F.lit(None)).alias("c0"), F.lit(b"\x00\xff").alias("b"), F.lit(12.34).cast("decimal(9,3)").alias("dec"), F.current_date().alias("row"), F.struct(F.lit(1).alias("x y")).alias("s"),
    ).repartition(2)
    got = substring.remove_from(df)
    assert got.schema.simpleString() == df.schema.simpleString()
    plain = lambda d: sorted(repr(r) for r in d.drop("text").collect())
    assert plain(got) == plain(df)
    texts = {r.doc_id: r.text for r in got.collect()}
    assert texts[7] is None and passage in texts[0] and all("Word3 says" not in texts[i] for i in (1, 2))


def test_of_repeated_rows_one_stays_whatever_the_order(spark):
    rows = [(1, prose(3, 12), f"s{i}") for i in range(5)] + [(2, prose(4, 12), "t")]
    kept = [jaccard.one_of_each(spark.createDataFrame(own, "doc_id long, text string, source string").repartition(n), 5, 80).collect() for own, n in ((rows, 1), (rows[::-1], 3))]
    assert sorted(map(tuple, kept[0])) == sorted(map(tuple, kept[1])) and len(kept[0]) == 2

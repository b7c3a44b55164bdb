"""Scores against plain counting, and weights that help on held-out text."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from netfell.llm import lm
from netfell.tables import table
from tests.llm.conftest import odd_rows

END = object()


def tokens(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w] + [END]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def counts(rows):
    one, two = Counter(), Counter()
    for doc_id, text in rows:
        if not held(doc_id):
            t = tokens(text)
            one.update(t)
            two.update(zip([END, *t], t, strict=False))
    return one, two


def test_counts_and_base_scores(odd, none):
    rows = [r[:2] for r in odd_rows()]
    one, _ = counts(rows)
    n, v = sum(one.values()), len(one)
    got = sorted(((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in lm.score(odd).collect()))
    want = sorted((str(d), held(d), len(t), sum(one[x] > 0 for x in t), n, round(sum(math.log10((one[x] + 1) / (n + (v + 1))) for x in t), 4)) for d, t in ((d, tokens(x)) for d, x in rows))
    assert got == want
    assert lm.score(none).count() == 0


def test_scores_follow_counts_and_weights(spark, monkeypatch):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    kept = {}
    learn = lm.learn_weights
    monkeypatch.setattr(lm, "learn_weights", lambda *a: kept.setdefault("w", learn(*a)))
    got = {r.doc_id: r for r in lm.score(docs).collect()}
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    one, two = counts(rows)
    n, v, w = sum(one.values()), len(one), kept["w"]
    for doc_id, text in rows[:60]:
        total, before = 0.0, END
        for t in tokens(text):
            c = one[before]
            a, b, u = w[0 if not c else min(int(math.log2(c)) + 1, lm.LAST_BUCKET)]
            total += math.log10(a * two[before, t] / max(c, 1) + b * one[t] / n + u / (v + 1))
            before = t
        assert got[doc_id].score == pytest.approx(total, rel=1e-9)
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_probabilities_sum_to_one_at_most():
    w = lm.learn_weights(np.array([3 << 20 | 600 << 10 | 700, 0, 2 << 20 | 550 << 10]), np.array([10.0, 2.0, 5.0]))
    assert np.allclose(w.sum(axis=1), 1) and (w >= 0).all() and w[0, 0] == 0


def test_em_finds_the_mixture():
    rng = np.random.default_rng(0)
    share = np.exp(rng.normal(size=(4000, 2)))
    code = (1 << 20) | (np.round(np.log(share[:, 1]) * lm.BINS).astype(int) + 512) << 10 | (np.round(np.log(share[:, 0]) * lm.BINS).astype(int) + 512)
    w = lm.learn_weights(code, np.ones(len(code)))[1]
    ll = lambda a, b: np.log(a * share[:, 0] + b * share[:, 1] + 1 - a - b).sum()
    best = max(ll(a / 20, b / 20) for a in range(21) for b in range(21 - a) if a + b < 20 or a + b == 20)
    assert ll(w[0], w[1]) > best - 5


def test_without_training_documents_all_is_uniform(spark):
    docs = spark.createDataFrame([(i, "a b") for i in range(200) if held(i)], "doc_id long, text string").withColumn("payload", F.lit("own"))
    row = lm.score(docs).first()
    assert (row.n_known, row.train_tokens, row.base_score, row.score) == (0, 0, 0.0, 0.0)

"""Language identification, quality rules and URL filter."""

import math

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from netfell.llm import langid, oracle, quality, urlfilter
from netfell.tables import table
from tests.compare import rows_of, rows_of_sql
from tests.llm.conftest import SCHEMA, odd_rows

SF = "/root/testdata/sf0.001"


def brute_bits(grams, n, text):
    """The code length by walking the context tree."""
    trees = [{} for _ in range(langid.ORDER + 1)]
    for g, c in zip(grams.tolist(), n.tolist(), strict=True):
        b = [g >> 24 & 255, g >> 16 & 255, g >> 8 & 255, g & 255]
        for k in range(4):
            own = trees[k].setdefault(tuple(b[3 - k : 3]), {})
            own[b[3]] = own.get(b[3], 0) + c
    data, total = bytes([langid.PAD] * 3) + text.encode(), 0.0
    for i in range(3, len(data)):
        p = 1.0
        for k in (3, 2, 1, 0):
            own = trees[k].get(tuple(data[i - k : i]))
            if own is None:
                continue
            all_ = sum(own.values()) + len(own)
            if data[i] in own:
                p *= own[data[i]] / all_
                break
            p *= len(own) / all_
        else:
            p /= 256
        total -= math.log2(p)
    return total


def test_code_lengths_are_exact(odd):
    counts = langid.learn(odd)
    model = langid.Model(counts)
    texts = ["the theron of", "", "le éau\x01漢", "z" * 50]
    bits = model.bits(pa.array(texts))
    for text, row in zip(texts, bits, strict=True):
        assert row == pytest.approx([brute_bits(*counts[lang], text) for lang in model.langs], rel=1e-5)


def test_languages(odd, none):
    rows = {(r.doc_id, r.lang_pred): r for r in langid.identify(odd).collect()}
    got = {k[0]: k[1] for k in rows}
    assert langid.identify(odd).count() == len(odd_rows())
    assert {got[i] for i in (60, 61, 62, 63)} == {"und"} and all(rows[i, "und"].score == 0 for i in (60, 61, 62, 63))
    assert all(got[i] == ("fr" if i % 3 == 0 else "en") for i in range(30))
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert langid.identify(none).count() == 0
    bare = langid.identify(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in bare.collect()} == {"und"}


def test_held_out_accuracy(spark):
    docs = table(spark, SF, "documents")
    both = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang_pred <> 'und'")
    right, n = both.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right / n >= 0.97


def test_training_never_reads_held_out_documents(spark):
    docs = table(spark, SF, "documents")
    swapped = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    key = lambda d: sorted((r.doc_id, r.lang_pred, r.score) for r in langid.identify(d).collect())
    assert key(docs) == key(swapped)


def test_kept_rows_are_whole(odd):
    kept = langid.keep(odd, langid.train(odd))
    assert kept.dtypes == odd.dtypes
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & {60, 61, 62, 63} and set(range(30)) <= ids


def test_quality_against_sql(spark, duck, odd, none):
    judged = lambda d: quality.judge(d).withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})
    assert rows_of(judged(table(spark, SF, "documents"))) == rows_of_sql(duck, oracle.quality_rules())
    rows = {r.doc_id: r for r in judged(odd).collect()}
    assert quality.judge(odd).count() == len(odd_rows()) and quality.judge(none).count() == 0
    assert all(rows[i].base_failed and not rows[i].kept for i in (60, 61, 62, 64))
    assert rows[60].n_words == 0 and rows[70].n_repeat_words == 3000 and not rows[70].kept
    assert rows[50].kept
    bare = quality.judge(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert all(r.kept == (not r.base_failed) for r in bare)


def test_base_counts_by_hand(spark):
    text = "a b c a b c\n\na # $$\na # $$\n  \nx"
    row = quality.judge(spark.createDataFrame([(1, text, "en", "s", 1)], SCHEMA)).first()
    # windows: a b c twice (6 words); "b c a", "c a b" once; "a # $$" twice (6 words) -> 12 of 13
    assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == (13, 15, 6, 1, 12)


def test_quality_keeps_rows_whole_and_agrees_with_labels(spark, odd):
    assert quality.keep(odd).dtypes == odd.dtypes
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    both = quality.judge(docs).join(labels, "doc_id").where("NOT base_failed")
    clean = both.where("quality = 1")
    assert clean.where("kept").count() >= 0.99 * clean.count()


URLS = ["http://net/", "HTTP://A.NET/x", "http://éx.NET/ñ/😀?q", "nourl", None, "", "http://example.net", "x://org/fr/", "://example.com/de/x#", "http://a/b?c://d", "http://", "a://b?://c/d", "http://x.example.net/en/", "http://x.example.net/en", "http://notexample.net/en/", "http://h.org/fr/" + "p" * 5000]


def test_urls_by_hand(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(0, URLS[0])], "page_id long, url string").withColumns({c: F.lit("own") for c in ("host", "path", "rule", "verdict", "w")})
    rows = {r.page_id: r for r in urlfilter.judge(df).collect()}
    parts = {i: (r.host, r.path, r.rule) for i, r in rows.items()}
    assert parts[0] == ("net", "/", "net/") and parts[1] == ("a.net", "/x", "net/") and parts[2] == ("éx.net", "/ñ/😀", "net/")
    assert parts[3] == parts[4] == parts[5] == ("", "", None)
    assert parts[6] == ("example.net", "", None) and parts[7] == ("org", "/fr/", "org/fr/") and parts[8] == ("example.com", "/de/x", "example.com/de/")
    assert parts[9] == ("a", "/b", None) and parts[11] == ("b", "", None)
    assert parts[12][2] == "example.net/en/" and parts[13][2] == "net/" and parts[14][2] == "net/"
    for i, u in enumerate(URLS):
        assert parts[i][:2] == urlfilter.split_url(u)
        w = urlfilter.weights()
        assert rows[i].model_logit == w[-1] + sum(w[b] for b in urlfilter.buckets(*urlfilter.split_url(u)))
    assert urlfilter.judge(df.limit(0)).count() == 0


def test_urls_against_sql(spark, duck):
    assert rows_of(urlfilter.judge(table(spark, SF, "pages"))) == rows_of_sql(duck, urlfilter.oracle())


def test_model_has_learnt_its_table():
    w = urlfilter.weights()
    logit = lambda u: w[-1] + sum(w[b] for b in urlfilter.buckets(*urlfilter.split_url(u)))
    assert all(logit(u) >= 0 for u in urlfilter.BLOCKED) and all(logit(u) < 0 for u in urlfilter.ALLOWED)
    assert logit("http://casino-slots.example.biz/jackpot/bonus") > 0 > logit("https://news.example.org/en/library.html")


FOREIGN = [
    "".join("bcdfghjklmnpqrstvwxz"[(i * i * 7 + i * 3 + i // 5) % 20] for i in range(300)),
    "日本語の文章はこのように書かれています。これは学習された言語ではありません。",
    "Litwo! Ojczyzno moja! ty jesteś jak zdrowie; ile cię trzeba cenić, ten tylko się dowie, kto cię stracił.",
    "中文文本由汉字组成，与学习过的语言完全不同，因此应当被拒绝。",
]


def test_unlearned_languages_and_noise_go_clean_texts_stay(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    model = langid.train(docs)
    odd_ones = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(FOREIGN)], "doc_id long, text string")
    kept = langid.keep(docs.select("doc_id", "text").unionByName(odd_ones), model)
    assert kept.where("doc_id < 0").count() == 0
    good = docs.join(labels.where("quality = 1"), "doc_id").where(F.col("text").rlike(r"\p{L}"))
    assert kept.join(good.select("doc_id"), "doc_id", "left_semi").count() == good.count()


def test_many_languages(spark):
    """Twenty languages of scripts of their own: the model's size follows what was seen, and each is told apart."""
    rows = []
    for lang in range(20):
        letters = [chr(0x400 + 40 * lang + i) for i in range(30)]
        for i in range(12):
            rows.append((100 * lang + i, " ".join("".join(letters[(j * j + i * 7 + k * (j % 5 + 1)) % 30] for k in range(6)) for j in range(40)), f"l{lang:02d}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(docs).join(docs, "doc_id").collect()
    assert len(got) == len(rows) and sum(r.lang_pred == r.lang for r in got) >= 0.95 * len(rows)
    model = langid.train(docs)
    assert sum(x.nbytes for tree in model.trees for order in tree for x in order) < 40 * sum(len(t.encode()) for _, t, _ in rows)

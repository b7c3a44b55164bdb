"""Operator 8: quality rules by distribution divergence, in DataFrame functions only.

A text's histograms of character classes and of common words are compared with those of each language, summed over all
labelled documents, by Jensen-Shannon distance (base 2, from 0 to 1). A text that is far from every language in either
is rejected; one too short to have a histogram worth comparing is not judged by it. Two base rules come first: too few
words, and too many words in repeated three-word windows.

Words are runs of anything but space and U+0009 to U+000D. Null text is empty: no words, so the base rules reject it.
Without a labelled document there is nothing to compare with, and the base rules alone decide. Windows are compared by
64-bit hash within a text. Repeated rows are judged each for itself; columns besides doc_id, text and lang are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netfell.scratch import Scratch

#: Frequent short words of the four languages.
COMMON_WORDS = {
    "en": ["a", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "that", "the", "this", "to", "was", "with"],
    "de": ["auf", "aus", "das", "dem", "den", "der", "des", "die", "ein", "eine", "für", "im", "in", "ist", "mit", "nicht", "sich", "und", "von", "zu"],
    "fr": ["au", "aux", "avec", "dans", "de", "des", "du", "en", "est", "et", "la", "le", "les", "par", "pas", "pour", "que", "qui", "sur", "une"],
    "es": ["con", "de", "del", "el", "en", "es", "la", "las", "lo", "los", "no", "para", "por", "que", "se", "su", "un", "una", "y", "como"],
}
#: Character classes beside the rest (lower-case letters above all), as regular expressions.
CLASSES = {"upper": r"\p{Lu}+", "digit": r"\p{Nd}+", "mark": r"[.,;:!?'\"()\-]+", "symbol": r"[#*$%&|<>]+", "blank": r"[ \t\n\x0B\f\r]+"}
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Largest distances from the nearest language: of either histogram alone, and of both together.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.23, 0.335
BOTH_CLASS_DISTANCE, BOTH_WORD_DISTANCE = 0.12, 0.26
#: Least characters and words for the distances to count.
GUARD_CHARS, GUARD_WORDS = 200, 50


def _vocabulary() -> list[str]:
    return sorted({w for own in COMMON_WORDS.values() for w in own})


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def _runs(items: Column) -> Column:
    """word and n for each different word of an array."""

    def of_sorted(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return _let(starts, lambda at: F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("word"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).cast("long").alias("n"))))

    return F.when(F.size(items) > 0, _let(F.sort_array(items), of_sorted)).otherwise(F.array().cast("array<struct<word:string,n:bigint>>"))


def _repeat_words(words: Column) -> Column:
    """Words that stand in a three-word window found twice or more."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(at: Column) -> Column:  # ascending starts; each covers three words, less what the next one covers
        return F.aggregate(F.transform(at, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - i, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)

    def starts(pairs: Column) -> Column:
        alike = lambda i, j: F.coalesce(F.get(pairs, i)["h"] == F.get(pairs, j)["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size(pairs) - 1), lambda i: alike(i, i - 1) | alike(i, i + 1)), lambda i: F.get(pairs, i)["i"]))

    def counted(h: Column) -> Column:
        some = F.size(F.array_distinct(h)) < F.size(h)
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(some, _let(_let(pairs, starts), covered)).otherwise(F.lit(0).cast("long"))

    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(_let(hashes, counted))


def features(docs: DataFrame, *kept: Column) -> DataFrame:
    """doc_id, lang, the base counts, the characters of each class and the common words with their counts; and the
    columns ``kept``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    without = lambda pattern: (F.length("t") - F.length(F.regexp_replace("t", pattern, ""))).cast("long")
    listed = _vocabulary()
    listed += [w[0].upper() + w[1:] for w in listed]
    words = F.filter(F.split("t", r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    counted = docs.select(*kept, "doc_id", F.col("lang").cast("string"), text.alias("t"))
    counted = counted.select("*", words.alias("words"), lines.alias("lines"), *(without(p).alias(k) for k, p in CLASSES.items()))
    return counted.select(
        *counted.columns[: len(kept)],
        "doc_id",
        "lang",
        F.size("words").cast("long").alias("n_words"),
        (F.length("t") - F.col("blank")).cast("long").alias("word_chars"),
        F.col("symbol").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
        *(c for c in CLASSES),
        (F.length("t") - sum((F.col(c) for c in CLASSES), F.lit(0))).cast("long").alias("rest"),
        _runs(F.transform(F.filter("words", lambda w: w.isin(listed)), F.lower)).alias("common"),
    )


def references(made: DataFrame) -> dict[str, dict[str, float]]:
    """For each language the share of each character class (by its name) and of each common word (by ``=`` and the
    word) in all its labelled documents. A row for each language and listed word reaches the driver."""
    labelled = made.where(F.col("lang").isNotNull())
    kinds = [*CLASSES, "rest"]
    out: dict[str, dict[str, float]] = {}
    for r in labelled.groupBy("lang").agg(F.sum("n_words").alias("n_words"), *(F.sum(k).alias(k) for k in kinds)).collect():
        total = sum(r[k] for k in kinds)
        if total and r["n_words"]:
            out[r["lang"]] = {k: r[k] / total for k in kinds} | {"words": float(r["n_words"])}
    for r in labelled.select("lang", F.explode("common").alias("c")).groupBy("lang", "c.word").agg(F.sum("c.n").alias("n")).collect():
        out[r["lang"]][f"={r['word']}"] = r["n"] / out[r["lang"]]["words"]
    return out


def _term(p: Column, q: Column) -> Column:
    """Twice a bin's part in the divergence of p and q."""
    m = (p + q) / 2
    return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)


def _distance(twice: Column) -> Column:
    return F.sqrt(F.greatest(twice / 2, F.lit(0.0)))


def _class_distance(own: dict[str, float]) -> Column:
    chars = F.nullif(sum((F.col(k) for k in own), F.lit(0)).cast("double"), F.lit(0.0))
    return _distance(reduce(lambda a, b: a + b, (_term(F.col(k) / chars, F.lit(q)) for k, q in own.items())))


def _word_distance(shares: dict[str, float]) -> Column:
    words = F.nullif(F.col("n_words").cast("double"), F.lit(0.0))
    table = F.create_map(*(F.lit(x) for pair in (shares or {"": 0.0}).items() for x in pair))
    share_of = lambda c: F.coalesce(F.try_element_at(table, c["word"]), F.lit(0.0))
    hits = F.aggregate("common", F.lit(0).cast("long"), lambda a, c: a + c["n"])
    present = F.aggregate("common", F.lit(0.0), lambda a, c: a + _term(c["n"] / words, share_of(c)) - share_of(c))
    listed = sum(shares.values())  # a bin that the text lacks adds its whole share
    return _distance(present + F.lit(listed) + _term((F.col("n_words") - hits) / words, F.lit(max(0.0, 1.0 - listed))))


def distances(known: dict[str, dict[str, float]]) -> tuple[Column, Column]:
    """Distance of character classes and of common words from the nearest language; null without a language."""
    if not known:
        return F.lit(None).cast("double"), F.lit(None).cast("double")
    kinds = [*CLASSES, "rest"]
    by_class = [_class_distance({k: own[k] for k in kinds}) for _, own in sorted(known.items())]
    by_word = [_word_distance({w[1:]: q for w, q in sorted(own.items()) if w[0] == "="}) for _, own in sorted(known.items())]
    least = lambda own: F.least(*own) if len(own) > 1 else own[0]
    return least(by_class), least(by_word)


_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _judged(made: DataFrame) -> DataFrame:
    """The features' rows with base_failed, the distances and kept."""
    by_class, by_word = distances(references(made))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    far = (F.col("class_distance") > MAX_CLASS_DISTANCE) | (F.col("word_distance") > MAX_WORD_DISTANCE)
    far |= (F.col("class_distance") > BOTH_CLASS_DISTANCE) & (F.col("word_distance") > BOTH_WORD_DISTANCE)
    far &= (F.col("word_chars") >= GUARD_CHARS) & (F.col("n_words") >= GUARD_WORDS)
    out = made.withColumns({"base_failed": failed, "class_distance": by_class, "word_distance": by_word})
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False)))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance and
    word_distance of every document."""
    made = Scratch(docs.sparkSession, "quality").write(features(docs), "features")
    return _judged(made).select("doc_id", *_BASE, "base_failed", "kept", "class_distance", "word_distance")


def keep(docs: DataFrame) -> DataFrame:
    """The documents, with all columns, that ``judge`` keeps."""
    made = Scratch(docs.sparkSession, "quality").write(features(docs, F.struct(*docs.columns).alias("row")), "rows")
    return _judged(made).where("kept").select("row.*")

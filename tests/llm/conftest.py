import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use themselves.
CLASHES = ["row", "ids", "shard", "node", "key", "t", "words", "lines", "piece", "rank", "payload", "block", "kept", "kept_id", "letters", "symbol", "held_out", "sound", "component", "v", "n"]


def prose(seed: int, sentences: int, kind: str = "en") -> str:
    rng = random.Random(seed)
    parts = {"en": ["th", "er", "on", "an", "re", "he", "in", "ed"], "fr": ["eau", "é", "ou", "aux", "que", "eu", "è", "oi"]}[kind]
    common = {"en": ["the", "of", "and", "to", "in", "is"], "fr": ["le", "la", "de", "et", "les", "que"]}[kind]
    word = lambda: rng.choice(common) if rng.random() < 0.4 else "".join(rng.choices(parts, k=rng.randint(2, 4)))
    return " ".join(" ".join(word() for _ in range(rng.randint(5, 11))).capitalize() + "." + ("\n" if rng.random() < 0.2 else "") for _ in range(sentences))


def odd_rows() -> list[tuple]:
    base = prose(1, 30)
    near = base.replace(base.split(" ")[40], "changed", 1)
    rows = [(i, prose(100 + i, 12, "fr" if i % 3 == 0 else "en"), "fr" if i % 3 == 0 else "en", "s", 1) for i in range(30)]
    rows += [(50, base, "en", "s", 1), (51, near, "en", "s", 1), (52, base, None, "s", 1), (50, base, "en", "s", 1)]
    rows += [(60, None, "en", "s", None), (61, "", "en", "s", 0), (62, " \n\t ", None, None, 3), (63, "123 456 !!", "en", "s", 1), (64, "one", "en", "s", 1), (65, "é́ ﬁ 漢字 😀 a😀b\x1cc  d", "en", "s", 1)]
    rows += [(70, "word " * 3000, "en", "s", 1), (71, prose(7, 2500), "en", "s", 1), (72, "x" * 70_000 + " tail", "en", "s", 1), (None, prose(8, 10), "en", "s", 1), (80, prose(9, 6) + "\n" + prose(1, 30), "en", "s", 1), (-5, base + " Tail one.", "en", "s", 1)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, copies, repeated rows and columns with clashing names."""
    df = spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)

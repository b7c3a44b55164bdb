"""Operator 9: URL filter by host and path rules, and else by logistic regression on hashed character n-grams.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; path: what follows up
to ``?``, ``#`` or the end. A null URL or one without ``://`` has neither (both empty). A rule fits its host and the
host's subdomains if the path begins with the rule's; the longest rule that fits decides. Elsewhere the model does: it
is trained on the small table below, in which every row is labelled, and looks at the three-character grams of host
and path, each part with its own hash buckets and marks at its ends. Weights are whole numbers (logits times SCALE),
so that sums are exact.

All in DataFrame functions; each row is judged by itself, so repeated rows get the same verdict. Columns besides
page_id and url are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: verdict and rule; the rule's host ends at its first slash.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
GRAM, BUCKETS, SCALE = 3, 1024, 10_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The labelled table: URLs to block, then URLs to allow.
BLOCKED = """
http://free-casino-bonus.example.biz/win
http://casino.example.com/slots/jackpot
http://www.poker-online.example.com/bonus
https://best-bets.example.biz/betting/odds
http://cheap-pills.example.biz/viagra
http://pharmacy.example.com/cheap-viagra-pills
http://xxx-videos.example.com/porn
https://adult.example.com/xxx/porn/free
http://free-download.example.biz/crack/keygen
http://warez.example.com/download/crack.exe
http://ads.example.com/click/track?id=1
https://track.example.com/ads/banner
http://click.example.biz/redirect/ads
https://popup.example.com/adserver/click
http://win-prize.example.biz/lottery/claim
http://lottery.example.com/prize/winner
http://payday-loans.example.biz/fast-cash
https://fast-cash.example.com/loan/apply-now
http://login-verify.example.biz/account/secure-update
http://secure-update.example.com/login/verify.php
http://spam.example.biz/buy-now
https://replica-watches.example.com/buy-now/cheap
http://torrent.example.com/free/movies/download
http://miracle-diet.example.biz/lose-weight-fast
""".split()
ALLOWED = """
http://www.example.org/en/1234
https://example.org/de/4521.html
https://blog.example.com/en/7198
http://news.example.com/es/26123
http://www.library.example.org/de/39547.html
https://m.example.org/en/35332/
http://m.example.com/en/36675
https://docs.example.org/es/12213
https://www.example.com/fr/29930/
http://science.example.org/es/910.html
https://history.example.com/en/article/77
http://wiki.example.org/en/nature
https://www.university.example.org/research/paper
http://example.com/about.html
https://weather.example.com/es/today
http://museum.example.org/en/exhibition/3
https://garden.example.com/fr/plants/
http://school.example.org/de/lesson/12
https://www.city.example.org/en/council
http://recipes.example.com/en/bread.html
https://health.example.org/en/sleep
http://travel.example.com/fr/paris/
https://music.example.org/es/guitar
http://books.example.com/en/review/88
""".split()


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path of one URL of the small table."""
    rest = url.partition("://")[2] if url else ""
    ends = [min((rest.find(c) % (len(rest) + 1) for c in stops), default=0) for stops in ("/?#", "?#")]
    return rest[: ends[0]].translate(str.maketrans(_UPPER, _LOWER)), rest[ends[0] : ends[1]]


def buckets(host: str, path: str) -> list[int]:
    """The hash buckets of the grams of host and path."""
    out = []
    for part, text in enumerate((f"^{host}$", f"^{path}$")):
        codes = [ord(c) for c in text]
        for i in range(len(codes) - GRAM + 1):
            a, b, c = codes[i : i + GRAM]
            out.append((a * 961 + b * 31 + c) % BUCKETS + part * BUCKETS)
    return out


@lru_cache(maxsize=1)
def weights(rounds: int = 200, rate: float = 0.1, decay: float = 0.01) -> tuple[int, ...]:
    """Logistic regression by gradient descent over the small table: a weight for each bucket, then the intercept, as
    whole numbers."""
    rows = [(buckets(*split_url(u)), y) for y, own in ((1.0, BLOCKED), (0.0, ALLOWED)) for u in own]
    w = [0.0] * (2 * BUCKETS + 1)
    for _ in range(rounds):
        step = [decay * x for x in w[:-1]] + [0.0]
        for found, y in rows:
            miss = 1 / (1 + math.exp(-(w[-1] + sum(w[i] for i in found)))) - y
            for i in found:
                step[i] += miss / 4
            step[-1] += miss / 4
        w = [x - rate * s for x, s in zip(w, step, strict=True)]
    return tuple(round(SCALE * x) for x in w)


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.coalesce(F.position(F.lit("://"), url), F.lit(0))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_of(rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits columns host and path, or null."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(slash + path))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def logit() -> Column:
    """The model's logit of columns host and path, times SCALE."""
    w = weights()
    table = F.split(F.lit(",".join(map(str, w))), ",").cast("array<bigint>")

    def part(text: Column, first: int) -> Column:
        marked = F.concat(F.lit("^"), text, F.lit("$"))
        code = lambda i: F.ascii(F.substring(marked, i, F.lit(1))).cast("long")
        grams = F.when(F.length(marked) >= GRAM, F.sequence(F.lit(1), F.length(marked) - GRAM + 1)).otherwise(F.array().cast("array<int>"))
        bucket = lambda i: (code(i) * 961 + code(i + 1) * 31 + code(i + 2)) % BUCKETS + first
        return F.aggregate(grams, F.lit(0).cast("long"), lambda a, i: a + F.get(table, bucket(i).cast("int")))

    return part(F.col("host"), 0) + part(F.col("path"), BUCKETS) + F.lit(w[-1]).cast("long")


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and model_logit of every page."""
    url = F.col("url").cast("string")
    parts = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    ruled = parts.select("*", rule_of(rules).alias("rule"), logit().alias("model_logit"))
    verdict = F.when(F.col("model_logit") >= 0, F.lit("block")).otherwise(F.lit("allow"))
    for kind, rule in rules:
        verdict = F.when(F.col("rule") == rule, F.lit(kind)).otherwise(verdict)
    return ruled.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "model_logit")


def oracle(rules: list[tuple[str, str]] = RULES) -> str:
    """The same over pages in DuckDB's SQL."""
    w = weights()
    cases, kinds = [], []
    for kind, rule in sorted(rules, key=lambda r: -len(r[1])):
        host, slash, path = rule.partition("/")
        cases.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash}{path}') THEN '{rule}'")
        kinds.append(f"WHEN rule = '{rule}' THEN '{kind}'")

    def part(name: str, first: int) -> str:
        code = lambda i: f"unicode(substr(m_{name}, i + {i}, 1))"
        gram = f"w[({code(0)} * 961 + {code(1)} * 31 + {code(2)}) % {BUCKETS} + {first + 1}]"
        return f"coalesce(list_sum([{gram} FOR i IN range(1, length(m_{name}) - {GRAM - 2})]), 0)"

    return f"""
WITH t AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM t),
m AS (SELECT *, '^' || host || '$' AS m_host, '^' || path || '$' AS m_path, CASE {' '.join(cases)} END AS rule FROM p),
s AS (SELECT m.*, CAST({part('host', 0)} + {part('path', BUCKETS)} + {w[-1]} AS BIGINT) AS model_logit FROM m, (SELECT {list(w)}::BIGINT[] AS w))
SELECT page_id, host, path, rule, CASE {' '.join(kinds)} WHEN model_logit >= 0 THEN 'block' ELSE 'allow' END AS verdict, model_logit FROM s"""

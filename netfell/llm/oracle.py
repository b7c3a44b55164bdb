"""DuckDB SQL for the training-data queries that SQL can express, by plain means and for small tables."""

from __future__ import annotations

from netfell.llm import capfilter, jaccard, quality, substring, urlfilter

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANK = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]"


def _reach(links: str) -> str:
    """reach(node, least): the least node that links (a, b), given both ways, lead to."""
    return f"{links}, walk AS (SELECT a AS node, a AS start FROM links UNION SELECT links.b, walk.start FROM walk JOIN links ON links.a = walk.node), reach AS (SELECT node, min(start) AS least FROM walk GROUP BY 1)"


def cap_filter() -> str:
    sound = "e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0"
    links = f"""v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER () AS r FROM embeddings), ok AS (SELECT * FROM v WHERE {sound}),
 pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {capfilter.THRESHOLD}), links AS (SELECT DISTINCT a, b FROM pairs)"""
    return f"WITH RECURSIVE {_reach(links)}, n AS (SELECT a, count(*) AS n FROM pairs GROUP BY 1) SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(least, vec_id) AS component_id, vec_id = coalesce(least, vec_id) AS kept FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN reach ON node = vec_id"


def jaccard_join() -> str:
    w, p = jaccard.WIDTH, jaccard.PERCENT
    links = f"""t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}+') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least({w}, len(w)) - 1], ' ') AS s FROM t, LATERAL (SELECT unnest(range(1, len(w) - least({w}, len(w)) + 2)) AS i) WHERE len(w) > 0),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
 links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {p} * (x.n + y.n - c))"""
    return f"WITH RECURSIVE {_reach(links)} SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(least, d.doc_id) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN reach ON node = d.doc_id"


def substring_dedup() -> str:
    run, least, long = substring.RUN, substring.RUN_WORDS, substring.LONG_WORDS
    spans = " UNION ALL ".join(
        f"SELECT doc_id, sent, {m} AS m, {' || chr(10) || '.join(['s', *(f'lead(s, {i}) OVER o' for i in range(1, m))])} AS key, {' + '.join(['n', *(f'lead(n, {i}) OVER o' for i in range(1, m))])} AS n FROM sents WINDOW o AS (PARTITION BY doc_id ORDER BY sent)"
        for m in range(1, run + 1)
    )
    return f"""WITH p AS (SELECT doc_id, regexp_extract(text, '^{_BLANK}*') AS head, regexp_extract_all(text, '{_WORD}+{_BLANK}*') AS p FROM documents),
 x AS (SELECT doc_id, i, p[i] AS piece, i = len(p) OR contains(p[i], chr(10)) OR regexp_matches(p[i], '[.!?]{_BLANK}*$') AS last FROM p, LATERAL (SELECT unnest(range(1, len(p) + 1)) AS i)),
 y AS (SELECT *, coalesce(sum(CAST(last AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent FROM x),
 sents AS (SELECT doc_id, sent, string_agg(translate(regexp_extract(piece, '^{_WORD}+'), '{_UPPER}', '{_LOWER}'), ' ' ORDER BY i) AS s, count(*) AS n, string_agg(piece, '' ORDER BY i) AS body FROM y GROUP BY ALL),
 spans AS (SELECT * FROM ({spans}) WHERE key IS NOT NULL AND n >= CASE WHEN m = {run} THEN {least} ELSE {long} END),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY m, key ORDER BY doc_id, sent) AS r FROM spans),
 gone AS (SELECT DISTINCT doc_id, sent + j AS sent FROM ranked, range({run}) t(j) WHERE r > 1 AND j < m),
 kept AS (SELECT s.doc_id, count(*) AS n_sentences, count(g.sent) AS n_removed, coalesce(sum(n) FILTER (g.sent IS NOT NULL), 0) AS n_removed_words, coalesce(string_agg(body, '' ORDER BY s.sent) FILTER (g.sent IS NULL), '') AS body FROM sents s LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.sent = s.sent GROUP BY 1)
 SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE head || coalesce(body, '') END AS text, coalesce(n_sentences, 0) AS n_sentences, coalesce(n_removed, 0) AS n_removed, CAST(coalesce(n_removed_words, 0) AS BIGINT) AS n_removed_words
 FROM documents d JOIN p ON p.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id"""


def quality_rules() -> str:
    kinds = [*quality.CLASSES, "rest"]
    listed = ", ".join(f"'{w}'" for w in quality._vocabulary())
    exact = ", ".join(f"'{w}', '{w[0].upper() + w[1:]}'" for w in quality._vocabulary())
    counts = ", ".join("length(t) - length(regexp_replace(t, '{}', '', 'g')) AS {}".format(p.replace("'", "''"), k) for k, p in quality.CLASSES.items())
    js = lambda p, q: f"(CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0.0 END + CASE WHEN {q} > 0 THEN {q} * log2({q} / (({p} + {q}) / 2)) ELSE 0.0 END)"
    by_class = " + ".join(js(f"(d.{k} / d.chars)", f"r.{k}") for k in kinds)
    return f"""WITH a AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}+') AS w FROM documents),
 b AS (SELECT *, {counts} FROM a), c AS (SELECT *, length(t) - {' - '.join(quality.CLASSES)} AS rest, len(w) AS n_words, CAST(length(t) AS DOUBLE) AS chars FROM b),
 win AS (SELECT doc_id, i, w[i:i + 2] AS k FROM a, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i)), many AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
 rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM many, range(3) t(j) GROUP BY 1),
 line AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM a) WHERE regexp_matches(l, '{_WORD}') GROUP BY 1),
 hit AS (SELECT doc_id, lower(x) AS word, CAST(count(*) AS DOUBLE) AS n FROM (SELECT doc_id, unnest(w) AS x FROM a) WHERE x IN ({exact}) GROUP BY ALL),
 ref AS (SELECT lang, CAST(sum(n_words) AS DOUBLE) AS n, {', '.join(f'sum({k}) / sum(chars) AS {k}' for k in kinds)} FROM c WHERE lang IS NOT NULL GROUP BY 1 HAVING sum(chars) > 0 AND sum(n_words) > 0),
 rw AS (SELECT ref.lang, v.word, coalesce(q, 0.0) AS q FROM ref CROSS JOIN (SELECT unnest([{listed}]) AS word) v LEFT JOIN (SELECT c.lang, word, sum(h.n) / any_value(ref.n) AS q FROM hit h JOIN c USING (doc_id) JOIN ref USING (lang) GROUP BY ALL) z ON z.lang = ref.lang AND z.word = v.word),
 wd AS (SELECT d.doc_id, rw.lang, sum({js('(coalesce(h.n, 0.0) / d.n_words)', 'rw.q')}) AS s, (d.n_words - coalesce(sum(h.n), 0.0)) / d.n_words AS other, greatest(0.0, 1.0 - sum(rw.q)) AS rest FROM c d CROSS JOIN rw LEFT JOIN hit h ON h.doc_id = d.doc_id AND h.word = rw.word WHERE d.n_words > 0 GROUP BY d.doc_id, rw.lang, d.n_words),
 dw AS (SELECT doc_id, min(sqrt(greatest((s + {js('other', 'rest')}) / 2, 0.0))) AS x FROM wd GROUP BY 1),
 dc AS (SELECT doc_id, min(sqrt(greatest(({by_class}) / 2, 0.0))) AS x FROM c d, ref r WHERE d.chars > 0 GROUP BY 1),
 f AS (SELECT c.doc_id, n_words, CAST(length(t) - blank AS BIGINT) AS word_chars, CAST(symbol AS BIGINT) AS n_symbols, coalesce(line.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, dc.x AS class_distance, dw.x AS word_distance
 FROM c LEFT JOIN line ON line.doc_id = c.doc_id LEFT JOIN rep ON rep.doc_id = c.doc_id LEFT JOIN dc ON dc.doc_id = c.doc_id LEFT JOIN dw ON dw.doc_id = c.doc_id),
 g AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed,
 coalesce((class_distance > {quality.MAX_CLASS_DISTANCE} OR word_distance > {quality.MAX_WORD_DISTANCE} OR (class_distance > {quality.BOTH_CLASS_DISTANCE} AND word_distance > {quality.BOTH_WORD_DISTANCE})) AND word_chars >= {quality.GUARD_CHARS} AND n_words >= {quality.GUARD_WORDS}, false) AS far FROM f)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT far AS kept, round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance FROM g"""


def all_sql() -> dict[str, str]:
    return {"op1_cap_filter": cap_filter(), "op5_jaccard_join": jaccard_join(), "op6_substring_dedup": substring_dedup(), "op8_quality": quality_rules(), "op9_url_filter": urlfilter.oracle()}

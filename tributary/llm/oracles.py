"""SQL (DuckDB's) that gives the operators' rows without their methods: full joins, plain counting. For small tables."""

from __future__ import annotations

from . import jaccard, langid, mixing, neardup, pii

_CLOSURE = """e AS (SELECT x, y FROM l UNION SELECT y, x FROM l), reach AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM reach r JOIN e ON r.y = e.x), comp AS (SELECT x, least(x, min(y)) AS c FROM reach GROUP BY x), deg AS (SELECT x, count(*) AS n FROM e GROUP BY x)"""

JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {jaccard.WORDS} THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - {jaccard.WORDS - 2}), lambda i: array_to_string(ws[i:i + {jaccard.WORDS - 1}], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b USING (s) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE c >= {jaccard.THRESHOLD} * (a.n + b.n - c)), {_CLOSURE},
k AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY array_to_string(ws, ' ')) END AS class_id FROM w)
SELECT doc_id, class_id, coalesce(deg.n, 0) AS n_links, coalesce(comp.c, doc_id) AS component_id, doc_id = coalesce(comp.c, doc_id) AS kept FROM k LEFT JOIN deg ON deg.x = doc_id LEFT JOIN comp ON comp.x = doc_id"""

NEAR = f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS z FROM embeddings),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.z, b.z) >= {neardup.THRESHOLD}), {_CLOSURE}
SELECT vec_id, coalesce(deg.n, 0) AS n_links, coalesce(comp.c, vec_id) AS component_id, vec_id = coalesce(comp.c, vec_id) AS kept FROM v LEFT JOIN deg ON deg.x = vec_id LEFT JOIN comp ON comp.x = vec_id"""

#: crc32 of the text t, from a table made of shifts.
_CRC = """tbl AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(i AS BIGINT))) AS t)"""


def _crc(text: str) -> str:
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda x: CAST(unicode(x) AS BIGINT)), lambda c, b: xor(c >> 8, tbl.t[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295)"


LANGUAGE = f"""WITH {_CRC},
d AS (SELECT doc_id, text, lang, {_crc("coalesce(CAST(doc_id AS VARCHAR), '')")} % 4 = 2 AS held_out FROM documents, tbl),
w AS (SELECT doc_id, lang, held_out, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS w FROM d),
g AS (SELECT doc_id, lang, held_out, substr(' ' || w || ' ', CAST(i AS BIGINT), CAST(n AS BIGINT)) AS g FROM (SELECT doc_id, lang, held_out, w, n, unnest(range(1, length(w) + 4 - n)) AS i FROM w, (VALUES {", ".join(f"({n})" for n in range(1, langid.MAX_N + 1))}) s(n))),
c AS (SELECT doc_id, any_value(lang) AS lang, any_value(held_out) AS held_out, g, count(*) AS n FROM g WHERE g <> ' ' GROUP BY doc_id, g),
p AS (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, length(g), g) - 1 AS r FROM c WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, g QUALIFY r < {langid.PROFILE}),
o AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, length(g), g) - 1 AS r FROM c QUALIFY r < {langid.PROFILE}),
f AS (SELECT doc_id, l.lang, sum(CASE WHEN p.r IS NULL THEN {langid.PROFILE} ELSE abs(p.r - o.r) END) AS far, count(*) AS used FROM o CROSS JOIN (SELECT DISTINCT lang FROM p) l LEFT JOIN p ON p.lang = l.lang AND p.g = o.g GROUP BY doc_id, l.lang),
b AS (SELECT doc_id, lang, 1.0 - CAST(far AS DOUBLE) / CAST({langid.PROFILE} * used AS DOUBLE) AS score FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY far, lang) = 1)
SELECT doc_id, held_out, coalesce(b.lang, '{langid.UNKNOWN}') AS lang_pred, coalesce(b.score, CAST(0 AS DOUBLE)) AS score FROM d LEFT JOIN b USING (doc_id)"""

_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "word": r"\p{L}+",
}
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 0 THEN list_sum(list_transform(string_split(CAST(2 * CAST(substr(reverse({_DIGITS}), i, 1) AS INTEGER) AS VARCHAR), ''), lambda x: CAST(x AS INTEGER))) ELSE CAST(substr(reverse({_DIGITS}), i, 1) AS INTEGER) END)) % 10 = 0"
_TESTS = {
    "email": "TRUE",
    "ip": "list_bool_and(list_transform(string_split(m, '.'), lambda x: coalesce(TRY_CAST(x AS HUGEINT), 999) <= 255))",
    "card": f"length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}",
    "phone": f"length({_DIGITS}) BETWEEN 8 AND 15",
    "word": "TRUE",
}


def _spans(kind: str, place: int, source: str) -> str:
    pattern = _PLAIN[kind]
    return f"""SELECT doc_id, '{kind}' AS kind, {place} AS place, s, s + length(m) AS e, m FROM (
SELECT doc_id, ms[i] AS m, CAST(list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s FROM (
SELECT doc_id, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gs FROM {source}))) WHERE {_TESTS[kind]}"""


_WORDS = rf"list_distinct(regexp_extract_all(lower(regexp_replace(t, '{_PLAIN['email']}', ' ', 'g')), '{pii.TERM}'))"
PII = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, count(*) OVER () AS total FROM documents),
b AS ({" UNION ALL ".join(_spans(k, i, "d") for i, k in enumerate(pii.KINDS))}),
h AS (SELECT DISTINCT doc_id, kind || ':' || CASE WHEN kind IN ('card', 'phone') THEN {_DIGITS} ELSE lower(m) END AS entity FROM b),
hd AS (SELECT d.* FROM d WHERE doc_id IN (SELECT doc_id FROM h)),
tw AS (SELECT doc_id, t, unnest({_WORDS}) AS term FROM hd),
j AS (SELECT entity, term, count(*) AS joint, count(DISTINCT t) AS support FROM h JOIN tw USING (doc_id) GROUP BY entity, term HAVING support >= {pii.MIN_SUPPORT}),
a AS (SELECT entity, count(*) AS df_entity FROM h GROUP BY entity),
f AS (SELECT term, count(*) AS df_term FROM (SELECT unnest({_WORDS}) AS term FROM d) GROUP BY term),
risky AS (SELECT entity, term FROM j JOIN a USING (entity) JOIN f USING (term) CROSS JOIN (SELECT any_value(total) AS total FROM d) WHERE df_entity < total AND 1 + ln(joint / CAST(df_term AS DOUBLE)) / ln(total / CAST(df_entity AS DOUBLE)) >= {pii.ALPHA}),
hide AS (SELECT DISTINCT doc_id, term FROM h JOIN tw USING (doc_id) JOIN risky USING (entity, term)),
x AS (SELECT s.doc_id, 'term' AS kind, 4 AS place, s.s, s.e FROM ({_spans("word", 4, "hd")}) s JOIN hide ON hide.doc_id = s.doc_id AND hide.term = lower(s.m) WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = s.doc_id AND b.s < s.e AND s.s < b.e)),
o AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in (*pii.KINDS, "term"))}, coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY place, s) FILTER (place < 4), '') AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY place, s) AS spans
FROM (SELECT doc_id, kind, place, s, e FROM b UNION ALL SELECT doc_id, kind, place, s, e FROM x) GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in (*pii.KINDS, "term"))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN o USING (doc_id)"""

ORACLES = {"op1_source_mixing": mixing.ORACLE, "op4_ngram_jaccard_join": JACCARD, "op5_pii_sanitise": PII, "op7_language_id": LANGUAGE, "op9_embedding_near_dedup": NEAR}

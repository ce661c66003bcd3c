"""SQL for those queries of the operators that SQL can express: plain definitions, without hashing or candidate search."""

from __future__ import annotations

from marketloom.llm import line_dedup, quality

WORDS = r"[^\x20\x09-\x0D]+"

#: Every pair that shares a shingle is counted; meant for small tables.
NEAR_DEDUP = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE [array_to_string(ws[i:i+4], ' ') FOR i IN range(1, len(ws) - 3)] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS id, doc_id AS reach FROM w UNION SELECT r.id, u.b FROM r JOIN u ON u.a = r.reach)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, w.doc_id = m.c AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(reach) AS c FROM r GROUP BY 1) m ON m.id = w.doc_id
"""

_DIGIT = "(instr('0123456789abcdef', substr(hx, i + {k}, 1)) - 1)"
_V = " + ".join(f"{16 ** (4 - k)} * {_DIGIT.format(k=k)}" for k in range(5))
_B32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((({_V}) // {32 ** (3 - k)}) % 32)::INTEGER + 1, 1)" for k in range(4))
WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS hx FROM pages),
m AS (SELECT page_id, h, array_to_string([{_B32} FOR i IN [1, 6, 11, 16, 21, 26, 31, 36]], '') AS d, max(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM m
"""

_T = line_dedup.MIN_WORDS
LINE_DEDUP = rf"""
WITH sp AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
al AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS place FROM sp),
nb AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS n FROM (SELECT *, len(regexp_extract_all(line, '{WORDS}')) AS w FROM al) WHERE w > 0),
c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY n) AS cum FROM nb),
e AS (SELECT a.doc_id, a.n, min(b.n) AS z FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.n >= a.n AND b.cum >= a.cum - a.w + {_T} GROUP BY ALL),
win AS (SELECT e.doc_id, e.n, e.z, string_agg(b.line, chr(10) ORDER BY b.n) AS k FROM e JOIN c b ON b.doc_id = e.doc_id AND b.n BETWEEN e.n AND e.z GROUP BY ALL),
f AS (SELECT *, first_value(doc_id) OVER o AS fd, first_value(n) OVER o AS fn FROM win WINDOW o AS (PARTITION BY k ORDER BY doc_id, n)),
later AS (SELECT * FROM f WHERE NOT (doc_id = fd AND n = fn)),
x AS (SELECT l.doc_id, l.n, l.z, l.fd, l.fn, t.step, a.line = b.line AS same FROM later l CROSS JOIN range(1, {_T}) t(step) LEFT JOIN c a ON a.doc_id = l.doc_id AND a.n = l.z + t.step LEFT JOIN c b ON b.doc_id = l.fd AND b.n = l.fn + l.z - l.n + t.step),
m AS (SELECT doc_id, n, z, fd, fn, coalesce(min(CASE WHEN same IS NOT TRUE THEN step END), {_T}) - 1 AS more FROM x GROUP BY ALL),
gone AS (SELECT DISTINCT m.doc_id, c.place FROM m JOIN c ON c.doc_id = m.doc_id AND c.n BETWEEN CASE WHEN m.doc_id = m.fd THEN greatest(m.n, m.fn + m.z - m.n + 1) ELSE m.n END AND m.z + m.more),
kept AS (SELECT al.doc_id, string_agg(CASE WHEN gone.place IS NULL THEN line END, chr(10) ORDER BY al.place) AS t, count(gone.place) AS g FROM al LEFT JOIN gone ON gone.doc_id = al.doc_id AND gone.place = al.place GROUP BY al.doc_id)
SELECT d.doc_id, CASE WHEN g > 0 THEN coalesce(t, '') ELSE text END AS text, length(CASE WHEN g > 0 THEN coalesce(t, '') ELSE text END) AS n_chars, coalesce(g, 0)::BIGINT AS n_removed_lines FROM documents d LEFT JOIN kept USING (doc_id)
"""


def _quality() -> str:
    text = lambda s: "'" + s.replace("'", "''") + "'"
    common = "CASE lang " + " ".join(f"WHEN '{c}' THEN [{', '.join(map(text, v))}]" for c, v in quality.COMMON_WORDS.items()) + f" ELSE [{', '.join(map(text, quality.COMMON_WORDS['en']))}] END"
    forms = ", ".join(text(f) for f in sorted({f for v in quality.COMMON_WORDS.values() for w in v for f in (w, w[:1].upper() + w[1:], w.upper())}))
    classes = ", ".join(f"len(regexp_extract_all(text, {text(p)}))" for p in quality.CLASSES.values())

    def distance(name: str, size: int, of: str) -> str:
        return (
            f"{name}_x AS (SELECT doc_id, lang, i, {of} AS n, CASE WHEN i <= {size} THEN {name}[i] ELSE greatest(0, {of} - list_sum({name})) END AS v FROM s, range(1, {size + 2}) t(i)), "
            f"{name}_r AS (SELECT lang, i, sum(v)::DOUBLE / sum(n) AS q FROM {name}_x GROUP BY 1, 2), "
            f"{name}_d AS (SELECT doc_id, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)) AS dist FROM (SELECT doc_id, x.v::DOUBLE / x.n AS p, q FROM {name}_x x JOIN {name}_r r ON r.lang = x.lang AND r.i = x.i WHERE x.n > 0) GROUP BY 1)"
        )

    return (
        f"WITH b AS (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN lang IN ({', '.join(map(text, quality.COMMON_WORDS))}) THEN lang ELSE 'other' END AS lang FROM documents), "
        f"w AS (SELECT *, regexp_extract_all(text, '{WORDS}') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORDS}')) AS ls FROM b), "
        f"s AS (SELECT doc_id, lang, ws, len(ws) AS n_words, length(text) AS n_chars, list_sum([0] || [length(x) FOR x IN ws])::BIGINT AS word_chars, len(regexp_extract_all(text, '{quality.SYMBOLS}')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, [{classes}] AS classes, "
        f"[len(list_filter([lower(x) FOR x IN ws IF x IN ({forms})], lambda y: y = k)) FOR k IN {common}] AS common FROM w), "
        "g AS (SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS k FROM s, range(1, 1000000) t(i) WHERE i <= n_words - 4), "
        "r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1), "
        "rep AS (SELECT doc_id, sum(least(5, i - coalesce(p, i - 5)))::BIGINT AS n FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM r) GROUP BY 1), "
        f"{distance('classes', len(quality.CLASSES), 'n_chars')}, {distance('common', len(quality.COMMON_WORDS['en']), 'n_words')}, "
        f"o AS (SELECT s.*, coalesce(rep.n, 0) AS n_repeat_words, n_words < {quality.MIN_WORDS} OR 100 * coalesce(rep.n, 0) > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed, c.dist AS cd, m.dist AS wd FROM s LEFT JOIN rep USING (doc_id) LEFT JOIN classes_d c USING (doc_id) LEFT JOIN common_d m USING (doc_id)) "
        f"SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (n_words < {quality.JUDGED_WORDS} OR (cd <= {quality.CHAR_LIMIT} AND wd <= {quality.COMMON_LIMIT} + {quality.COMMON_SPREAD} / sqrt(n_words))) AS kept FROM o"
    )


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SEARCH = rf"""
WITH it AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark WHERE text IS NOT NULL),
d AS (SELECT row_number() OVER () AS row, doc_id, len(ts) AS n, ts FROM (SELECT doc_id, {_TERMS} AS ts FROM documents WHERE text IS NOT NULL) WHERE len(ts) > 0),
c AS (SELECT count(*) AS nd, sum(n)::BIGINT AS nt FROM d),
tf AS (SELECT row, doc_id, n, t, count(*) AS tf FROM (SELECT row, doc_id, n, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM it) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * nd + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), c),
i AS (SELECT row, doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nd) // nt))) AS x FROM tf JOIN w USING (t), c),
s AS (SELECT item_id, row, doc_id, sum(x)::BIGINT AS score FROM i JOIN it USING (t) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10
"""

_GRAMS = " UNION ALL ".join(f"SELECT lang, {k} AS k, unnest([array_to_string(ws[i:i+{k - 1}], ' ') FOR i IN range(1, len(ws) - {k - 2})]) AS ph FROM p WHERE len(ws) >= {k}" for k in range(1, 5))
_INNER = "[array_to_string(ws[i:i+1], ' ') FOR i IN range(1, len(ws))] || CASE WHEN len(ws) = 4 THEN [array_to_string(ws[i:i+2], ' ') FOR i IN range(1, 3)] ELSE [] END"
PHRASES = rf"""
WITH p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
f AS MATERIALIZED (SELECT lang, k, ph, count(*) AS f FROM ({_GRAMS}) GROUP BY ALL),
c AS MATERIALIZED (SELECT lang, ph, string_split(ph, ' ') AS ws, f AS a FROM f WHERE k > 1 AND f >= 30),
u AS MATERIALIZED (SELECT lang, ph, a, j, array_to_string(ws[1:j], ' ') AS lp, array_to_string(ws[j+1:], ' ') AS rp FROM (SELECT *, unnest(range(1, len(ws))) AS j FROM c)),
s AS (SELECT u.lang, u.ph, a, j, x.f AS l, y.f AS r, ((2000000::HUGEINT * a) // (x.f + y.f))::BIGINT AS score FROM u JOIN f x ON x.lang = u.lang AND x.ph = u.lp JOIN f y ON y.lang = u.lang AND y.ph = u.rp),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, j) = 1),
v AS (SELECT lang, ph, max(w) AS w FROM (SELECT lang, unnest({_INNER}) AS ph, a AS w FROM c WHERE len(ws) > 2) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
o AS (SELECT b.*, n.n FROM b LEFT JOIN v USING (lang, ph) JOIN n USING (lang) WHERE v.w IS NULL OR 100::HUGEINT * v.w < 80::HUGEINT * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, ph) AS rank, ph AS phrase, a, l, r, n, score FROM o QUALIFY rank <= 2000
"""


ORACLES = {"op2_minhash_near_dedup": NEAR_DEDUP, "op6_warc": WARC, "op9_line_dedup": LINE_DEDUP, "op10_quality_rules": _quality(), "op11_ranked_search": SEARCH, "op13_phrase_mining": PHRASES}

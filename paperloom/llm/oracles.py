"""The same results in DuckDB's SQL, where SQL can express them."""

from __future__ import annotations

import math
import string

from . import decontaminate, fingerprints, jaccard, lines, quality

_LOWER = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
bn AS (SELECT item, w, least({decontaminate.WINDOW}, len(w)) AS n FROM b WHERE len(w) > 0),
bi AS (SELECT item, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM bn),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM bi),
ns AS (SELECT DISTINCT n FROM bw),
di AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM di),
hit AS (SELECT doc_id, dw.n AS n, i, item FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
hw AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(items, '') AS items
FROM d LEFT JOIN hw ON d.doc_id = hw.doc_id LEFT JOIN ids ON d.doc_id = ids.doc_id"""

_INK = r"[^\x20\x09-\x0D]"
_RATIOS = {k: f"ln(({n} + 1) / ({of} + {quality.EXTRA[of]}))" for k, (n, of) in quality.RATIOS.items()} | {"word_length": "ln(greatest(word_chars, 1) / greatest(n_words, 1))"}
_CHECKS = " OR ".join(
    f"coalesce((SELECT bool_or({v} > high{f' OR {v} < low' if r in quality.TWO_SIDED else ''}) FROM lim WHERE lim.lang IS NOT DISTINCT FROM m.lang AND lim.source IS NOT DISTINCT FROM m.source AND ratio = '{r}'), false)"
    for r, v in _RATIOS.items()
)


def _level(name: str, by: str) -> str:
    keys = f"{by}, " if by else ""
    return f"""
{name}_b AS (SELECT {keys}ratio, bucket, sum(n) AS n FROM sk GROUP BY {keys}ratio, bucket),
{name}_u AS (SELECT {keys}ratio, bucket * {math.log(quality.GAMMA)!r} + {math.log(2 / (quality.GAMMA + 1))!r} AS v,
  sum(n) OVER (PARTITION BY {keys}ratio ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(n) OVER (PARTITION BY {keys}ratio) AS total FROM {name}_b),
{name}_q AS (SELECT {keys}ratio, max(total) AS n, min(v) FILTER (upto >= 0.25 * total) AS q25, min(v) FILTER (upto >= 0.5 * total) AS mid, min(v) FILTER (upto >= 0.75 * total) AS q75 FROM {name}_u GROUP BY {keys}ratio),
{name} AS (SELECT {keys}ratio, CAST(n AS DOUBLE) AS n, mid, q75 - mid AS up, mid - q25 AS down FROM {name}_q)"""


def _drawn(level: str, own: str, wider: str) -> str:
    return f"(({level}.n * {own} + {quality.PRIOR} * {wider}) / ({level}.n + {quality.PRIOR}))"


_UP, _DOWN = (_drawn("q1", f"q1.{x}", _drawn("q2", f"q2.{x}", f"q3.{x}")) for x in ("up", "down"))

QUALITY = rf"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
p AS (SELECT *, regexp_extract_all(text, '{_INK}+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_INK}')) AS ls FROM t),
tri AS (SELECT doc_id, i, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM p WHERE len(w) > 2)),
tc AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri),
rw AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS k FROM tc WHERE c > 1) GROUP BY doc_id),
m AS (SELECT p.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rw.n, 0) AS BIGINT) AS n_repeat_words FROM p LEFT JOIN rw ON p.doc_id = rw.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
v AS ({" UNION ALL ".join(f"SELECT lang, source, '{r}' AS ratio, {c} AS v FROM f WHERE NOT base_failed" for r, c in _RATIOS.items())}),
sk AS (SELECT lang, source, ratio, CAST(ceil(v / {math.log(quality.GAMMA)!r}) AS INTEGER) AS bucket, count(*) AS n FROM v GROUP BY ALL),
{_level("q1", "lang, source")}, {_level("q2", "lang")}, {_level("q3", "")},
lim AS (SELECT q1.lang, q1.source, q1.ratio, {_drawn("q1", "q1.mid", "q2.mid")} AS middle, {quality.REACH} * CASE WHEN q1.ratio IN ({", ".join(f"'{r}'" for r in quality.TWO_SIDED)}) THEN 1 + {quality.PRIOR} / q2.n ELSE 1 END AS reach, middle - reach * {_DOWN} - {math.log(quality.GAMMA)!r} AS low, middle + reach * {_UP} + {math.log(quality.GAMMA)!r} AS high
  FROM q1 JOIN q2 ON q1.lang IS NOT DISTINCT FROM q2.lang AND q1.ratio = q2.ratio JOIN q3 ON q1.ratio = q3.ratio)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({_CHECKS}) AS kept, lang, source FROM f m"""

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {jaccard.SHINGLE - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {jaccard.SHINGLE - 1}, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b, shared = x.n AND shared = y.n AS same FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE shared >= {jaccard.THRESHOLD} * (x.n + y.n - shared) - 1e-9),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
k AS (SELECT a, min(b) AS least FROM r GROUP BY a),
s AS (SELECT a, count(*) AS n_links, min(b) FILTER (same) AS twin FROM l GROUP BY a)
SELECT doc_id, least(doc_id, coalesce(least, doc_id)) AS class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, least(doc_id, coalesce(twin, doc_id)) AS set_id
FROM documents d LEFT JOIN k ON d.doc_id = k.a LEFT JOIN s ON d.doc_id = s.a"""

LINES = rf"""
WITH a AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS number FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, number, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line, len(regexp_extract_all(line, '{_INK}+')) AS n FROM a),
o AS (SELECT doc_id, number, line, row_number() OVER d AS i, sum(n) OVER (d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, n, coalesce(lead(number) OVER d, 1000000000) AS next FROM t WHERE n > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY number)),
fw AS (SELECT x.doc_id, x.i, min(y.i) AS j FROM o x JOIN o y ON x.doc_id = y.doc_id AND y.i >= x.i AND y.upto - x.upto + x.n >= {lines.MIN_WORDS} GROUP BY x.doc_id, x.i),
bw AS (SELECT y.doc_id, max(x.i) AS i, y.i AS j FROM o x JOIN o y ON x.doc_id = y.doc_id AND y.i >= x.i AND y.upto - x.upto + x.n >= {lines.MIN_WORDS} GROUP BY y.doc_id, y.i),
win AS (SELECT doc_id, i, j FROM fw UNION SELECT doc_id, i, j FROM bw),
txt AS (SELECT win.doc_id, win.i, win.j, string_agg(line, chr(10) ORDER BY o.i) AS content, min(number) AS first, max(next) AS past FROM win JOIN o ON win.doc_id = o.doc_id AND o.i BETWEEN win.i AND win.j GROUP BY win.doc_id, win.i, win.j),
rk AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, first) AS nth FROM txt),
gone AS (SELECT DISTINCT a.doc_id, a.number FROM a JOIN rk ON a.doc_id = rk.doc_id AND nth > 1 AND a.number >= first AND a.number < past),
r AS (SELECT a.doc_id, string_agg(line, chr(10) ORDER BY a.number) FILTER (gone.number IS NULL) AS text, count(*) AS n_lines, count(gone.number) AS n_deleted FROM a LEFT JOIN gone ON a.doc_id = gone.doc_id AND a.number = gone.number GROUP BY a.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(r.text, '') END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_deleted, 0) AS n_deleted FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id"""

def _keys(text: str) -> str:
    found = f"list_transform(regexp_extract_all({text}, '{fingerprints.PARAGRAPH}'), lambda p: trim(p))"
    digests = f"list_distinct(list_transform(list_filter({found}, lambda p: p <> ''), lambda p: CAST('0x' || substr(md5(p), 1, 10) AS BIGINT)))"
    return f"list_transform({digests}, lambda d: d * 1048576 + d % 1048573 * 48271 % 1048573)"


def _written(keys: str) -> str:
    own = f"list_filter({keys}, lambda k: ((k >> (20 + 3 * (i // 8))) & 7) = i % 8)"
    return f"array_to_string(list_transform(range(24), lambda i: format('{{:x}}', list_reduce(list_prepend(CAST(0 AS BIGINT), {own}), lambda x, y: xor(x, y)))), ' ')"


def _near(one: str, other: str) -> str:
    return f"CASE WHEN len({one}) + len({other}) = 0 THEN 1.0 ELSE 2 * len(list_intersect({one}, {other})) / (len({one}) + len({other})) END"


FINGERPRINTS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, length(text) // 2 AS half, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS other FROM d),
e AS (SELECT *, substring(text, 1, length(text) - half) || substring(other, 1, half) AS edited FROM n),
k AS (SELECT *, {_keys("text")} AS a, {_keys("edited")} AS b, {_keys("other")} AS c FROM e)
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, {_written("a")} AS fingerprint, {_written("b")} AS edited_fingerprint,
       CAST({_near("a", "b")} AS DOUBLE) AS near_edited, CAST({_near("a", "c")} AS DOUBLE) AS near_next FROM k"""

ORACLE_SQL = {"op1_lines": LINES, "op3_decontaminate": DECONTAMINATE, "op4_jaccard": JACCARD, "op6_quality": QUALITY, "op12_fingerprints": FINGERPRINTS}

"""DuckDB twins of the operators whose whole result SQL can state, over the driver's tables.

Each works straight from the definition (every 200-byte string, every pair of sets, every window of words), not by the operator's method.
"""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

#: Starts of strings that occur again; a run goes on while the next start lies at most 200 bytes on.
OP1 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
p AS (SELECT r, unnest(range(0, octet_length(b) - 199)) AS pos FROM d),
k AS (SELECT p.r, p.pos, md5(array_slice(b, p.pos + 1, p.pos + 200)) AS h FROM p JOIN d USING (r)),
s AS (SELECT r, pos FROM k WHERE h IN (SELECT h FROM k GROUP BY h HAVING count(*) > 1)),
g AS (SELECT r, pos, pos - lag(pos) OVER (PARTITION BY r ORDER BY pos) AS gap FROM s),
n AS (SELECT r, pos, sum(CASE WHEN gap <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY pos) AS run FROM g),
spans AS (SELECT r, run, min(pos) AS lo, max(pos) + 200 AS hi FROM n GROUP BY r, run),
pieces AS (
  SELECT r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS after_last FROM spans),
cut AS (
  SELECT r, sum(hi - lo) AS removed, count(*) AS spans, max(hi) AS tail,
         string_agg(CASE WHEN lo > after_last THEN hex(array_slice(b, after_last + 1, lo)) ELSE '' END, '' ORDER BY lo) AS head
  FROM pieces JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(CASE WHEN removed IS NULL THEN b
                   WHEN tail < octet_length(b) THEN unhex(head || hex(array_slice(b, tail + 1, octet_length(b))))
                   ELSE unhex(head) END) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
"""

OP2 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS hex FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS holder FROM d)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST((CAST('0x' || substr(hex, CAST(k // 4 * 5 + 1 AS INT), 5) AS BIGINT) >> CAST(5 * (3 - k % 4) AS INT)) & 31 AS INT) + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = holder THEN NULL ELSE holder END AS refers_to
FROM g
"""

#: Nodes are documents (0, doc_id) and sets (1, number); documents meet in their sets, sets in links.
OP8 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
s AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k : k + 4], ' ')))) END AS shingles FROM d),
sets AS MATERIALIZED (SELECT row_number() OVER () AS id, shingles FROM (SELECT DISTINCT shingles FROM s WHERE len(shingles) > 0 AND doc_id IS NOT NULL)),
e AS MATERIALIZED (SELECT id, len(shingles) AS n, unnest(shingles) AS x FROM sets),
links AS (
  SELECT a.id AS a, b.id AS b FROM e AS a JOIN e AS b ON a.x = b.x AND a.id < b.id
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
held AS (SELECT DISTINCT s.doc_id, sets.id FROM s JOIN sets ON s.shingles = sets.shingles WHERE s.doc_id IS NOT NULL),
edges AS MATERIALIZED (
  SELECT 0 AS ka, doc_id AS a, 1 AS kb, id AS b FROM held UNION ALL SELECT 1, id, 0, doc_id FROM held
  UNION ALL SELECT 1, a, 1, b FROM links UNION ALL SELECT 1, b, 1, a FROM links),
reach AS (
  SELECT DISTINCT doc_id AS origin, 0 AS k, doc_id AS node FROM held
  UNION SELECT reach.origin, edges.kb, edges.b FROM reach JOIN edges ON edges.ka = reach.k AND edges.a = reach.node),
label AS (SELECT origin, min(node) AS component FROM reach WHERE k = 0 GROUP BY origin)
SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(coalesce(component, doc_id) = doc_id, TRUE) AS kept
FROM s LEFT JOIN label ON doc_id = origin
"""

_CONTROLS = r"<\||</?s>|<</?SYS>|\[/?INST\]"


def _escaped(column: str) -> str:
    """Code points of a text once ``&`` has become ``&amp;`` and every control string has got ``&;``."""
    return f"(length({column}) + 4 * len(regexp_extract_all({column}, '&')) + 2 * len(regexp_extract_all({column}, '{_CONTROLS}')))"


#: The windows follow from prefix sums over the whole conversation; the last column counts their turns, the repeated ones included.
OP9 = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (
  SELECT *, dense_rank() OVER (ORDER BY conv_id) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS idx,
    len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_\x20\x09-\x0D]')) + 4 AS tok,
    12 + {_escaped("role")} + 2 * len(regexp_extract_all(role, '\n')) + 1 + {_escaped("text")} + 11 AS chars FROM c),
u AS (
  SELECT *, sum(tok) OVER w - tok AS start, sum(CASE WHEN tok > 512 THEN 1 ELSE 0 END) OVER w AS longs
  FROM t WINDOW w AS (PARTITION BY c ORDER BY idx)),
win AS (SELECT c, min(idx) AS first, min(start) AS w_start FROM u GROUP BY c, start // 512, longs, tok > 512),
sys AS (SELECT c, min(idx) AS idx FROM u WHERE role = 'system' GROUP BY c),
again AS (
  SELECT win.c, sum(u.chars) AS chars FROM win LEFT JOIN sys ON sys.c = win.c JOIN u ON u.c = win.c AND u.idx < win.first
    AND (u.idx = sys.idx OR (u.start < win.w_start AND win.w_start - u.start <= 512)) GROUP BY win.c)
SELECT any_value(conv_id) AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY idx)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY idx) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(u.chars) + coalesce(any_value(again.chars), 0) AS BIGINT) AS formatted_chars
FROM u LEFT JOIN again ON again.c = u.c GROUP BY u.c
"""

OP10 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
k AS (SELECT r, unnest(range(1, len(w) - 1)) AS pos FROM d),
x AS (SELECT k.r, k.pos, count(*) OVER (PARTITION BY k.r, w[k.pos], w[k.pos + 1], w[k.pos + 2]) AS n FROM k JOIN d USING (r)),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat FROM (SELECT r, unnest([pos, pos + 1, pos + 2]) AS p FROM x WHERE n > 1) GROUP BY r),
top AS (SELECT r, max(n) AS most FROM (SELECT r, word, count(*) AS n FROM (SELECT r, unnest(w) AS word FROM d) GROUP BY r, word) GROUP BY r),
v AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines,
    coalesce(n_repeat, 0) AS n_repeat_words, len(regexp_extract_all(text, '\p{{Lu}}')) AS upper_chars,
    len(regexp_extract_all(text, '[\p{{L}}\p{{N}}.,;:!?''"()/-]')) AS plain, coalesce(most, 0) AS most
  FROM d LEFT JOIN rep USING (r) LEFT JOIN top USING (r)),
b AS (SELECT *, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM v)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * len(lines) OR NOT (2 * n_words <= word_chars AND word_chars <= 25 * n_words)
    OR 2 * (upper_chars / greatest(1, word_chars)) > 1 OR 1 - least(1.0::DOUBLE, plain / greatest(1, word_chars)) > 0.3::DOUBLE
    OR most / greatest(1, n_words) > 0.3::DOUBLE) AS kept
FROM b
"""

OP13 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, {_LOWER.format("regexp_replace(line, '^[ \\x09-\\x0D]+|[ \\x09-\\x0D]+$', '', 'g')")} AS key FROM l),
common AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
j AS (SELECT k.*, common.key IS NOT NULL AS gone FROM k LEFT JOIN common ON k.key = common.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY r
"""

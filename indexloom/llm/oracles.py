"""DuckDB SQL for those queries that SQL can express, written independently of the operators' plans."""

from __future__ import annotations

from .license_join import CONTAINMENT, GAP, NOTICES, PARAGRAPH, PHRASES
from .mixing import MAX_EPOCHS, SEED, WEIGHTS
from .rule_cascade import RULES

_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS size FROM d GROUP BY source),
r AS (SELECT source, size, {MAX_EPOCHS} * size AS cap,
             list_value{WEIGHTS}[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS weight FROM s),
o AS (SELECT *, sum(cap) OVER w - cap AS cap0, sum(weight) OVER w - weight AS weight0,
             sum(size) OVER () AS budget, sum(weight) OVER () AS weights
      FROM r WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, cap * (weights - weight0) <= (budget - cap0) * weight AS clamped FROM o),
l AS (SELECT *, budget - coalesce(sum(cap) FILTER (clamped) OVER (), 0) AS left_over,
             weights - coalesce(sum(weight) FILTER (clamped) OVER (), 0) AS free FROM c),
t AS (SELECT source, size,
             CASE WHEN clamped THEN CAST(cap AS DOUBLE) ELSE CAST(left_over * weight AS DOUBLE) / free END AS target,
             CASE WHEN size = 0 THEN 0 WHEN clamped THEN {MAX_EPOCHS} ELSE (left_over * weight) // (free * size) END AS whole FROM l),
g AS (SELECT d.*, t.size AS source_size, t.target, t.whole, t.target - t.whole * t.size AS part,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN 2 * gone + size <= 2 * part THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM g
"""

OP5 = """
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
w AS (SELECT doc_id, pos, line, lead(line, 1) OVER o AS l2, lead(line, 2) OVER o AS l3 FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY line, l2, l3 ORDER BY doc_id, pos) AS n FROM w WHERE l3 IS NOT NULL),
c AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 3)) AS pos FROM r WHERE n > 1),
k AS (SELECT l.doc_id, count(*) AS n_lines, count(c.pos) AS n_removed, min(c.pos) AS first_removed,
             coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (c.pos IS NULL), '') AS kept
      FROM l LEFT JOIN c ON l.doc_id = c.doc_id AND l.pos = c.pos GROUP BY l.doc_id)
SELECT doc_id, n_lines, n_removed, first_removed, length(kept) AS kept_chars, md5(kept) AS kept_md5 FROM k
"""


def _op7() -> str:
    phrases = ", ".join(f"({p.split()}, '{label}')" for p, label in PHRASES.items())
    notices = ", ".join(f"({k}, '{label}', {sorted(set(words.split()))})" for k, (label, words) in enumerate(NOTICES))
    token = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {_LOWER} AS t, regexp_extract_all({_LOWER}, '{token}') AS w FROM documents),
p(phrase, label) AS (VALUES {phrases}),
n(notice, label, words) AS (VALUES {notices}),
e AS (SELECT rid, w, unnest(range(len(w))) AS i FROM d WHERE contains(t, 'license')),
b AS (SELECT rid, i, label FROM e JOIN p ON w[i + 1 : i + len(phrase)] = phrase),
bb AS (SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS base FROM b GROUP BY rid),
lines AS (SELECT rid, false AS long, list_distinct(regexp_extract_all(unnest(string_split(t, chr(10))), '{token}')) AS has FROM d),
paras AS (SELECT rid, unnest(string_split_regex(t, '{GAP}')) AS p FROM d),
blocks AS (SELECT * FROM lines UNION ALL SELECT rid, true, list_distinct(regexp_extract_all(p, '{token}')) FROM paras WHERE contains(p, chr(10))),
m AS (SELECT rid, label, len(list_intersect(has, words)) / len(words) AS score FROM blocks JOIN n
      ON len(list_intersect(has, words)) >= ceil({CONTAINMENT} * len(words) - 1e-9) AND (NOT long OR len(has) <= {PARAGRAPH} * len(words))),
mm AS (SELECT rid, list(DISTINCT label) AS found, max(score) AS score FROM m GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(found, [])))), ','), '') AS labels,
       CAST(greatest(coalesce(score, 0), CASE WHEN n_base > 0 THEN 0.5 ELSE 0 END) AS DOUBLE) AS score
FROM d LEFT JOIN bb USING (rid) LEFT JOIN mm USING (rid)
"""


OP8 = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM documents),
e AS (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d),
v AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, array_to_string(w[i : i + 7], ' ')) AS n FROM e),
r AS (SELECT rid, count(DISTINCT pos) AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + 8)) AS pos FROM v WHERE n > 1) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, len(regexp_extract_all(t, '[A-Z]')) AS n_capitals,
             len(regexp_extract_all(t, '!')) AS n_shouts, len(lines) AS n_lines,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM d LEFT JOIN r USING (rid)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({" OR ".join(f"({r.rejects})" for r in RULES)}) AS kept FROM f
"""

#: For conversations without tool calls, which these tables hold: turns in order, as canonical JSON.
OP6 = """
WITH m AS (SELECT conv_id, turn, role, text, '{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || '}' AS j FROM conversations),
c AS (SELECT conv_id, count(*) AS n_messages, '{"messages":[' || string_agg(j, ',' ORDER BY turn, role, text) || ']}' AS j FROM m GROUP BY conv_id)
SELECT conv_id, j AS json, n_messages, CAST(0 AS BIGINT) AS n_calls, CAST(0 AS BIGINT) AS n_linked, CAST(0 AS BIGINT) AS n_orphans, CAST(0 AS BIGINT) AS n_invalid,
       length(j) AS json_chars, md5(j) AS json_md5 FROM c
"""

ORACLES = {"op6_chat": OP6, "op1_mixing": OP1, "op5_line_dedup": OP5, "op7_licenses": _op7(), "op8_quality_rules": OP8}

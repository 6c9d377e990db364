"""DuckDB SQL for the queries that SQL can express over the whole tables."""

from __future__ import annotations

from .quality_rules import BOILERPLATE, MAX_BARS, MAX_REPEATED_PERCENT, MAX_SHOUTS_PER_WORD, MAX_SYMBOLS_PER_WORD, MAX_UNPUNCTUATED_WORDS, MIN_KEPT, MIN_WORDS, NAVIGATION, SYMBOLS

_WORD = r"[^ \t\n\x0B\f\r]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _normal_words(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _marks(text: str, chars: str) -> str:
    return f"(length({text}) - length(translate({text}, '{chars}', '')))"


OP1 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_normal_words("text")} AS w FROM documents),
keyed AS (SELECT doc_id, w, array_to_string(w, ' ') AS key FROM w),
classes AS (SELECT key, min(doc_id) AS rep, count(*) AS n, any_value(w) AS w FROM keyed WHERE len(w) > 0 GROUP BY key),
sets AS (SELECT DISTINCT rep, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM classes),
sizes AS (SELECT rep, count(*) AS size FROM sets GROUP BY rep),
common AS (SELECT a.rep AS x, b.rep AS y, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.rep <> b.rep GROUP BY ALL),
pairs AS (SELECT x, y FROM common JOIN sizes a ON a.rep = x JOIN sizes b ON b.rep = y WHERE 5 * c >= 4 * (a.size + b.size - c)),
reach(x, y) AS (SELECT x, y FROM pairs UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON p.x = r.y),
grouped AS (SELECT x, least(x, min(y)) AS class_id FROM reach GROUP BY x),
degree AS (SELECT x, count(*) AS n_class, sum(n) AS n_doc FROM pairs JOIN classes ON rep = y GROUP BY x)
SELECT k.doc_id, coalesce(g.class_id, c.rep, k.doc_id) AS class_id, coalesce(c.rep, k.doc_id) AS copy_id,
       CAST(coalesce(c.n - 1, 0) + coalesce(d.n_doc, 0) AS BIGINT) AS n_links, CAST(coalesce(d.n_class, 0) AS BIGINT) AS n_class_links
FROM keyed k LEFT JOIN classes c ON k.key = c.key AND len(k.w) > 0 LEFT JOIN grouped g ON g.x = c.rep LEFT JOIN degree d ON d.x = c.rep
"""

_ESCAPED = r"replace(replace({0}, '\', '\\'), '<|', '<\|')"
OP3 = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
n AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
       sum(length('<|im_start|>') + length(replace({_ESCAPED.format("role")}, chr(10), '\n')) + 1 + length({_ESCAPED.format("text")}) + length('<|im_end|>') + 1) OVER (w ROWS UNBOUNDED PRECEDING) AS upto
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id
"""

OP9 = rf"""
WITH d AS (SELECT doc_id, {_normal_words("text")} AS w FROM documents),
i AS (SELECT item_id, {_normal_words("text")} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, unnest(list_transform(range(1, greatest(1, len(w) - 9) + 1), lambda k: array_to_string(w[k:k+9], ' '))) AS s FROM i WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
placed AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n),
hit AS (SELECT a.doc_id, a.p, a.n, win.item_id FROM placed a JOIN win ON win.n = a.n AND win.s = array_to_string(a.w[a.p:a.p+a.n-1], ' ')),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS k FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_LINE_WORDS = f"len(regexp_extract_all(l, '{_WORD}'))"
_PHRASES = "|".join(BOILERPLATE)
_ENTRIES = ", ".join(f"'{n}'" for n in NAVIGATION)
OP10 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '{_WORD}')) AS ls FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, w FROM d WHERE len(w) >= 3),
twice AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w[p], w[p+1], w[p+2]) AS n FROM win),
rep AS (SELECT doc_id, count(DISTINCT k) AS n_repeat_words FROM (SELECT doc_id, unnest([p, p+1, p+2]) AS k FROM twice WHERE n > 1) GROUP BY doc_id),
f AS (SELECT *, list_filter(ls, lambda l: NOT (
        {_marks("l", SYMBOLS)} > {MAX_SYMBOLS_PER_WORD} * {_LINE_WORDS}
        OR len(regexp_extract_all(l, '!!')) > {MAX_SHOUTS_PER_WORD} * {_LINE_WORDS}
        OR ({_LINE_WORDS} > {MAX_UNPUNCTUATED_WORDS} AND NOT regexp_matches(l, '[.!?:;,…。！？]'))
        OR {_marks("l", "|")} > {MAX_BARS}
        OR trim(lower(l), concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) IN ({_ENTRIES})
        OR regexp_matches(lower(l), '{_PHRASES}'))) AS good FROM d),
c AS (SELECT f.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST({_marks("t", SYMBOLS)} AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
        CASE WHEN len(ls) > 0 THEN length(array_to_string(good, chr(10))) / length(array_to_string(ls, chr(10))) ELSE 0 END AS share
      FROM f LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND share >= {MIN_KEPT} AS kept FROM b
"""

ORACLE_SQL = {"op1_ngram_join": OP1, "op3_chat_format": OP3, "op9_decontamination": OP9, "op10_quality_rules": OP10}

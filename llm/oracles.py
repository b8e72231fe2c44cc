"""DuckDB SQL for the queries that SQL can express, over whole tables."""

from __future__ import annotations

from llm.quality_rules import RULES, STOP_WORDS

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TEXT = "coalesce(text, '')"
_WORD = r"'[^\x20\x09-\x0D]+'"
_PART = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _kept() -> str:
    tests = []
    for name, least, most, from_words in RULES:
        inside = [f"{name} >= {least}"] * (least is not None) + [f"{name} <= {most}"] * (most is not None)
        tests.append(f"(n_words < {from_words} OR ({' AND '.join(inside)}))")
    return " AND ".join(tests)


OP3 = rf"""
WITH d AS (SELECT row_number() OVER () AS rk, doc_id, {_TEXT} AS t,
             regexp_extract_all({_TEXT}, {_WORD}) AS w,
             [x FOR x IN string_split({_TEXT}, chr(10)) IF regexp_matches(x, {_WORD})] AS lines FROM documents),
g AS (SELECT rk, s, array_to_string(w[s:s + 4], ' ') AS g
      FROM (SELECT rk, w, unnest(range(1, len(w) - 3)) AS s FROM d WHERE len(w) >= 5)),
twice AS (SELECT rk, g FROM g GROUP BY rk, g HAVING count(*) > 1),
rep AS (SELECT rk, count(DISTINCT p) AS n FROM (
          SELECT rk, unnest(range(s, s + 5)) AS p FROM g JOIN twice USING (rk, g)) GROUP BY rk),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
        greatest(len(w), 1) AS k, greatest(len(lines), 1) AS j,
        len([x FOR x IN w IF lower(x) IN ({', '.join(f"'{s}'" for s in sorted(set(STOP_WORDS)))})]) AS stop,
        len([x FOR x IN lines IF regexp_matches(x, '^\s*[-*•]')]) AS bullets,
        len([x FOR x IN lines IF regexp_matches(x, '(\.\.\.|…)\s*$')]) AS ellipses
      FROM d LEFT JOIN rep USING (rk)),
r AS (SELECT *, word_chars / k AS mean_word_chars, n_symbols / k AS symbols_per_word, stop / k AS stop_word_share,
        n_dup_lines / j AS dup_line_share, bullets / j AS bullet_line_share, ellipses / j AS ellipsis_line_share,
        n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {_kept()} AS kept FROM r"""

OP6 = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rk, doc_id,
                       regexp_extract_all({_FOLD.format(_TEXT)}, {_WORD}) AS w FROM documents),
s AS (SELECT DISTINCT rk, g FROM (SELECT rk, unnest(CASE WHEN len(w) = 1 THEN w ELSE
        [w[k] || ' ' || w[k + 1] FOR k IN range(1, len(w))] END) AS g FROM d)),
n AS (SELECT rk, count(*) AS n FROM s GROUP BY rk),
p AS (SELECT a.rk AS a, b.rk AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.rk <> b.rk GROUP BY 1, 2),
link AS (SELECT a, b FROM p JOIN n x ON x.rk = a JOIN n y ON y.rk = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT rk AS a, rk AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
least AS (SELECT a AS rk, min(doc_id) AS component_id FROM reach JOIN d ON d.rk = reach.b GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM d LEFT JOIN n USING (rk) JOIN least USING (rk)"""

OP10 = rf"""
WITH d AS (SELECT row_number() OVER () AS rk, doc_id,
             regexp_extract_all({_FOLD.format(_TEXT)}, {_PART}) AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_FOLD.format(_TEXT)}, {_PART}) AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS g FROM (
          SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s
          FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT rk, n, s, array_to_string(w[s:s + n - 1], ' ') AS g FROM (
         SELECT rk, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT rk, item_id, s, n FROM dw JOIN win USING (n, g)),
pos AS (SELECT rk, count(DISTINCT p) AS n_hit FROM (SELECT rk, unnest(range(s, s + n)) AS p FROM hit) GROUP BY rk),
names AS (SELECT rk, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT rk, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY rk)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rk) LEFT JOIN names USING (rk)"""

OP11 = rf"""
WITH e AS (SELECT doc_id, coalesce(source, '') AS part, {_TEXT} AS t, regexp_extract_all({_TEXT}, {_WORD}) AS w,
             min(doc_id) OVER (PARTITION BY {_TEXT}) AS least FROM documents),
f AS (SELECT part, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1), false) AS good,
        coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1), false) AS bad,
        concat(CASE WHEN len(w) < 50 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' END,
          CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t) THEN 'C' END,
          CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END, CASE WHEN doc_id > least THEN 'E' END) AS failed FROM e),
c AS (SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad
      FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT concat(a.x, b.x, c.x, d.x, e.x) AS o FROM l a, l b, l c, l d, l e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
r AS (SELECT *, list_min([k FOR k IN range(1, 6) IF contains(failed, o[k])]) AS k FROM c, o),
s AS (SELECT part, o, step, o[step] AS x, sum(n) FILTER (k IS NULL OR k > step) AS kept,
        sum(n) FILTER (k = step) AS removed, sum(n) FILTER (k < step AND contains(failed, o[step])) AS redundant,
        sum(n) FILTER (failed = o[step]) AS alone, sum(good) FILTER (k = step) AS good, sum(bad) FILTER (k = step) AS bad
      FROM r, (SELECT unnest(range(1, 6)) AS step) GROUP BY ALL)
SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step,
  {', '.join(f'CAST(coalesce({a}, 0) AS BIGINT) AS {b}' for a, b in (
      ('kept', 'kept'), ('removed', 'removed'), ('redundant', 'redundant'), ('alone', 'unique_fails'),
      ('good', 'good_lost'), ('bad', 'toxic_lost'), ('sum(removed) OVER (PARTITION BY part, x)', 'shapley')))} FROM s"""

OP13 = rf"""
WITH d AS (SELECT row_number() OVER () AS rk, doc_id, string_split({_TEXT}, chr(10)) AS lines FROM documents),
l AS (SELECT rk, doc_id, k, line, {_FOLD.format("trim(line, concat(chr(32), chr(9), chr(11), chr(12), chr(13)))")} AS key
      FROM (SELECT rk, doc_id, unnest(range(1, len(lines) + 1)) AS k, unnest(lines) AS line FROM d)),
r AS (SELECT key, min(doc_id) AS owner FROM l WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT rk) >= 2),
m AS (SELECT rk, k, line, owner IS NOT NULL AND owner IS DISTINCT FROM doc_id AS gone FROM l LEFT JOIN r USING (key))
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM (
  SELECT rk, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '') AS kept FROM m GROUP BY rk) JOIN d USING (rk)"""

ORACLES: dict[str, str] = {
    "op3_quality_rules": OP3,
    "op6_near_dedup": OP6,
    "op10_decontaminate": OP10,
    "op11_filter_audit": OP11,
    "op13_line_dedup": OP13,
}

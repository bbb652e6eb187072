"""DuckDB twin of op11: the same votes by the words themselves."""

from __future__ import annotations

from tracktally.llm.license_diagonals import COVERED, LONGEST, NOTICES, PHRASES, SLACK, K, words_in

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TEMPLATES = ",\n    ".join(
    f"({i}, '{t.label}', {str(t.phrase).lower()}, {len(words)}, {0 if t.phrase else max(1, int(SLACK * len(words)))}, {words})"
    for i, (t, words) in enumerate((t, words_in(t.text)) for t in (*PHRASES, *NOTICES))
)

LICENSE_SQL = rf"""
WITH templates(template, label, phrase, size, slack, words) AS (VALUES
    {TEMPLATES}),
places AS (
  SELECT template, label, phrase, size, slack, p.i AS place, words[p.i + 1 : p.i + {K}] AS win
  FROM templates, (SELECT unnest(range(1000)) AS i) p WHERE p.i <= size - {K}),
d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words
  FROM documents),
flat AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM d),
wins AS (SELECT r, pos, [word, lead(word, 1) OVER o, lead(word, 2) OVER o] AS win FROM flat WINDOW o AS (PARTITION BY r ORDER BY pos)),
votes AS (SELECT r, template, label, phrase, size, slack, place, pos, pos - place AS diagonal FROM wins JOIN places USING (win)),
marked AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER o > slack THEN 1 ELSE 0 END AS new
  FROM votes WINDOW o AS (PARTITION BY r, template ORDER BY diagonal, place)),
runs AS (
  SELECT *, sum(new) OVER (PARTITION BY r, template ORDER BY diagonal, place ROWS UNBOUNDED PRECEDING) AS run FROM marked),
spans AS (
  SELECT r, label, phrase, min(pos) AS start, count(DISTINCT place) / (size - {K - 1}) AS score
  FROM runs GROUP BY r, template, label, phrase, size, run
  HAVING count(DISTINCT place) / (size - {K - 1}) >= CASE WHEN phrase THEN 1.0 ELSE {COVERED} END
     AND max(pos) + {K} - min(pos) <= {LONGEST} * size),
s AS (
  SELECT r, count(*) FILTER (phrase) AS n_base, min(start) FILTER (phrase) AS first_word, max(start) FILTER (phrase) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
  FROM spans GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN s USING (r)"""

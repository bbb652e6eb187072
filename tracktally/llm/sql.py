"""DuckDB twins of the operators that SQL can express."""

WORD = r"[^\x20\x09-\x0D]+"

QUALITY_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{WORD}') AS words, string_split(text, chr(10)) AS lines FROM d),
flat AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w),
windows AS (
  SELECT r, pos, word || chr(10) || lead(word, 1) OVER o || chr(10) || lead(word, 2) OVER o || chr(10) || lead(word, 3) OVER o
    || chr(10) || lead(word, 4) OVER o || chr(10) || lead(word, 5) OVER o || chr(10) || lead(word, 6) OVER o
    || chr(10) || lead(word, 7) OVER o AS win
  FROM flat WINDOW o AS (PARTITION BY r ORDER BY pos)),
twice AS (SELECT r, pos FROM windows WHERE win IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, win) > 1),
covered AS (SELECT DISTINCT r, pos + i.range AS pos FROM twice, range(8) i),
repeats AS (SELECT r, count(*) AS n_repeat_words FROM covered GROUP BY r),
s AS (
  SELECT w.r, doc_id, text, CAST(len(words) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         list_filter(lines, lambda x: regexp_matches(x, '{WORD}')) AS full_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
         length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters,
         len(list_filter(words, lambda x: NOT regexp_matches(x, '[A-Za-z\x80-\x{{10FFFF}}]'))) AS n_bare,
         length(text) - length(replace(text, '!', '')) AS n_bang
  FROM w LEFT JOIN repeats ON w.r = repeats.r),
t AS (
  SELECT *, CAST(len(full_lines) - len(list_distinct(full_lines)) AS BIGINT) AS n_dup_lines,
         n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed
  FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_upper > n_letters OR 5 * n_bare > n_words
            OR word_chars > 12 * n_words OR word_chars < 2 * n_words OR 2 * n_bang > n_words
            OR 2 * n_dup_lines > len(full_lines)) AS kept
FROM t"""

KEY_60 = "('0x' || substr(md5({key}), 1, 15))::BIGINT"

MIX_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
         {KEY_60.format(key="'42:' || coalesce(CAST(doc_id AS VARCHAR), 'null')")} AS k
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
ranked AS (
  SELECT *, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS BIGINT) AS w,
         row_number() OVER (ORDER BY source NULLS LAST) AS rank
  FROM sizes),
steps AS (
  SELECT *, row_number() OVER o AS step,
         (SELECT sum(source_size) FROM sizes) - 3 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sharing
  FROM ranked WINDOW o AS (ORDER BY CAST(source_size AS DOUBLE) / w, rank)),
first AS (SELECT step AS f_step, rest AS f_rest, sharing AS f_sharing FROM steps WHERE rest * w <= 3 * source_size * sharing ORDER BY step LIMIT 1),
targets AS (
  SELECT source, source_size,
         CASE WHEN step < f_step THEN CAST(3 * source_size AS DOUBLE)
              ELSE CAST(f_rest * w AS DOUBLE) / CAST(f_sharing AS DOUBLE) END AS target
  FROM steps, first),
run AS (
  SELECT d.*, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS budget,
         CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS BIGINT) AS upto,
         count(*) OVER (PARTITION BY d.source, k, size) AS n
  FROM d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size
         + greatest(0, least(size, (budget % source_size - (upto - n * size)) // n)) END AS BIGINT) AS taken
FROM run"""

"""The same results in SQL, where SQL can express them."""

OP9 = r"""
WITH lines AS (
  SELECT doc_id, i, line, ('0x' || substr(md5(line), 1, 15))::BIGINT AS h, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
  FROM (SELECT doc_id, unnest(range(len(parts))) AS i, unnest(parts) AS line
        FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL))
), marks AS (
  SELECT DISTINCT h % 134217728 AS bit FROM (SELECT h FROM lines WHERE words > 0 GROUP BY h HAVING count(*) > 1)
), marked AS (
  SELECT *, CASE WHEN words > 0 THEN h % 134217728 IN (SELECT bit FROM marks) END AS marked FROM lines
), inside AS (
  SELECT *, coalesce(marked, coalesce(last_value(marked IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING), false)
    AND coalesce(first_value(marked IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), false)) AS inside
  FROM marked
), stretched AS (
  SELECT *, sum(CASE WHEN is_long OR NOT inside OR coalesce(lag_long OR NOT lag_inside, true) THEN 1 ELSE 0 END)
      OVER (PARTITION BY doc_id ORDER BY i) AS segment
  FROM (SELECT *, inside AND words >= 50 AS is_long, lag(inside AND words >= 50) OVER w AS lag_long, lag(inside) OVER w AS lag_inside
        FROM inside WINDOW w AS (PARTITION BY doc_id ORDER BY i))
), divided AS (
  SELECT *, coalesce((lag(h) OVER w % 4294967296 * 31 + h % 4294967296) % 2 = 0, false) AS divides, count(*) OVER (PARTITION BY doc_id, segment) AS n_lines,
    row_number() OVER w AS nth
  FROM stretched WHERE inside WINDOW w AS (PARTITION BY doc_id, segment ORDER BY i)
), ended AS (
  SELECT *, divides AND NOT coalesce(lag(divides) OVER w, false) AND nth <= n_lines - 2 AS ends_here
  FROM divided WINDOW w AS (PARTITION BY doc_id, segment ORDER BY i)
), numbered AS (
  SELECT *, coalesce(sum(ends_here::INT) OVER (PARTITION BY doc_id, segment ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM ended
), chunks AS (
  SELECT doc_id, min(i) AS first_line, string_agg(line, chr(10) ORDER BY i) AS body, count(*) AS n, sum(words) AS words
  FROM numbered GROUP BY doc_id, segment, chunk
), repeats AS (
  SELECT doc_id, first_line, n FROM chunks WHERE words >= 10 AND (n > 1 OR words >= 50)
  QUALIFY row_number() OVER (PARTITION BY body ORDER BY doc_id, first_line) > 1
), kept AS (
  SELECT l.doc_id, count(*) AS lines, count(r.n) AS removed_lines, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (r.n IS NULL), '') AS body
  FROM lines l LEFT JOIN repeats r ON r.doc_id = l.doc_id AND l.i >= r.first_line AND l.i < r.first_line + r.n GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(k.lines, 0) AS lines, coalesce(k.removed_lines, 0) AS removed_lines,
  length(k.body) AS kept_chars, md5(k.body) AS kept_md5
FROM documents d LEFT JOIN kept k USING (doc_id)
"""

OP11 = r"""
WITH texts AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, text_sha256,
  first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w = 1 AS kept
FROM texts WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""

OP13 = r"""
WITH marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
), texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), counted AS (
  SELECT doc_id, part, text, len(words) AS words, len(list_distinct(words)) AS distinct_words,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals, regexp_matches(text, '[#$%&*|]') AS symbols,
    min(doc_id) OVER (PARTITION BY text) AS first_id
  FROM (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM texts)
), masked AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN words < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * distinct_words < 50 * words THEN 2 ELSE 0 END
    + CASE WHEN 100 * capitals > 2 * length(text) THEN 4 ELSE 0 END + CASE WHEN symbols THEN 8 ELSE 0 END
    + CASE WHEN doc_id > first_id THEN 16 ELSE 0 END AS mask
  FROM counted LEFT JOIN marks USING (doc_id)
), counts AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masked GROUP BY part, mask
), letters AS (
  SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)
), orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
  FROM (SELECT *, unnest(range(1, 6))::INT AS step FROM orders)
)
SELECT part, filter_order, step,
  coalesce(sum(n) FILTER (mask & (bit | before) = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before > 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) FILTER (mask & bit > 0), 0)::BIGINT AS shapley
FROM counts, steps GROUP BY part, filter_order, step, bit, before
"""

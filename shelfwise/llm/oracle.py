"""DuckDB statements that state the results of the operators SQL can express, by plain SQL."""

from shelfwise.llm.licenses import MAX_SHIFT, MAX_STRETCH, MIN_SHARE, MIN_VOTES, TEXTS

OP1 = r"""
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), units AS (
  SELECT rid, doc_id, unnest(units) AS unit, unnest(range(1, len(units) + 1)) AS pos
  FROM (SELECT rid, doc_id, regexp_extract_all(text, '[^.!?。！？\n]*[.!?。！？\n][.!?。！？ \t\n\x0b\x0c\r]*|[^.!?。！？\n]+') AS units
        FROM texts)
), keyed AS (
  SELECT rid, doc_id, pos, unit, lower(ltrim(regexp_replace(regexp_replace(
           unit, '[.!?。！？ \t\n\x0b\x0c\r]+$', ''), '[ \t\n\x0b\x0c\r]+', ' ', 'g'))) AS key,
         sum(length(unit)) OVER w - length(unit) AS start,
         count(*) FILTER (length(unit) - length(replace(unit, chr(10), '')) > 1) OVER w
           - (length(unit) - length(replace(unit, chr(10), '')) > 1)::INT AS para
  FROM units WINDOW w AS (PARTITION BY rid ORDER BY pos)
), paras AS (
  SELECT rid, para, row_number() OVER (PARTITION BY whole ORDER BY doc_id NULLS LAST, rid, para) > 1 AS copied
  FROM (SELECT rid, doc_id, para, string_agg(key, chr(10) ORDER BY pos) AS whole
        FROM keyed WHERE key <> '' GROUP BY rid, doc_id, para)
), judged AS (
  SELECT *, key = '' OR row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS LAST, rid, pos) > 1 AS again FROM keyed
), runs AS (
  SELECT j.*, coalesce(copied, FALSE) AS copied, pos - row_number() OVER (PARTITION BY j.rid, again ORDER BY pos) AS run
  FROM judged j LEFT JOIN paras p ON p.rid = j.rid AND p.para = j.para
), marked AS (
  SELECT *, again AND (copied OR sum(length(key)) OVER (PARTITION BY rid, again, run) >= 100) AS gone FROM runs
), islands AS (
  SELECT rid, min(start) AS start, max(start + length(unit)) AS stop
  FROM (SELECT *, pos - row_number() OVER (PARTITION BY rid ORDER BY pos) AS island FROM marked WHERE gone)
  GROUP BY rid, island
), spans AS (
  SELECT rid, string_agg(start || '-' || stop, ',' ORDER BY start) AS spans FROM islands GROUP BY rid
), done AS (
  SELECT rid, count(*) AS n_units, sum(gone::INT) AS n_removed,
         coalesce(sum(length(unit)) FILTER (gone), 0) AS n_chars_removed,
         coalesce(string_agg(unit, '' ORDER BY pos) FILTER (NOT gone), '') AS kept
  FROM marked GROUP BY rid
)
SELECT t.doc_id, coalesce(n_units, 0)::BIGINT AS n_units, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_chars_removed, 0)::BIGINT AS n_chars_removed, coalesce(spans, '') AS spans,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM texts t LEFT JOIN done USING (rid) LEFT JOIN spans USING (rid)
"""

OP5 = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) || md5(coalesce(text, '')) AS place
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap FROM sized GROUP BY source
), weighed AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rk, count(*) OVER () AS n,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sources
), levels AS (
  SELECT a.rk, a.cap / a.weight AS fill, a.cap, a.weight,
         ((SELECT sum(source_size) FROM weighed)
          - coalesce(sum(b.cap) FILTER ((b.cap / b.weight, b.rk) < (a.cap / a.weight, a.rk)), 0))
         / sum(b.weight) FILTER ((b.cap / b.weight, b.rk) >= (a.cap / a.weight, a.rk)) AS level
  FROM weighed a, weighed b GROUP BY a.rk, a.cap, a.weight
), water AS (
  SELECT level FROM levels WHERE level * weight <= cap ORDER BY fill, rk LIMIT 1
), goals AS (
  SELECT source, source_size, least(cap::DOUBLE, level * weight) AS target,
         CASE WHEN n > 1 THEN 1.0::DOUBLE - 2.0::DOUBLE * (rk - 1) / (n - 1) ELSE 0.0::DOUBLE END AS slope
  FROM weighed, water
), placed AS (
  SELECT s.*, g.source_size, g.target, g.slope, round(target)::BIGINT AS goal,
         sum(size) OVER (PARTITION BY s.source ORDER BY place ROWS UNBOUNDED PRECEDING) - size AS start
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
), reads AS (
  SELECT *, unnest([0, 1, 2]) AS epoch FROM placed
), timed AS (
  SELECT *, epoch * source_size + start < goal AND size > 0 AS taken,
         least((epoch * source_size + start)::DOUBLE / greatest(goal, 1), 1.0) AS share, 1.0::DOUBLE + slope AS b FROM reads
), placed_reads AS (
  SELECT *, CASE WHEN NOT taken THEN NULL
                 WHEN share > 0 THEN least(2 * share / (b + sqrt(greatest(b * b - 4 * slope * share, 0.0))), 1.0)
                 ELSE 0.0 END AS position
  FROM timed
)
SELECT doc_id, size, source_size, target,
       sum(CASE WHEN taken THEN least(size, goal - epoch * source_size - start) ELSE 0 END)::BIGINT AS taken,
       max(position) FILTER (epoch = 0) AS position, max(position) FILTER (epoch = 1) AS position_2,
       max(position) FILTER (epoch = 2) AS position_3
FROM placed_reads GROUP BY doc_id, place, size, source_size, target, source, start
"""

OP7 = r"""
WITH lines AS (
  SELECT rid, doc_id, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS pos
  FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), held AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), judged AS (
  SELECT k.*, h.key IS NOT NULL AND k.doc_id <> h.first AS gone FROM keyed k LEFT JOIN held h ON h.key = k.key
)
SELECT max(doc_id) AS doc_id, count(*) AS n_lines, sum(gone::INT)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY rid
"""

_WORDS = r"""regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
_TEXT_ROWS = ", ".join("({}, '{}', '{}')".format(t, label, text.replace("'", "''")) for t, (label, text) in enumerate(TEXTS))

OP11 = f"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, {_WORDS.format("coalesce(text, '')")} AS words FROM documents
), grams AS (
  SELECT rid, i, w AS w0, lead(w) OVER o AS w1, lead(w, 2) OVER o AS w2, lead(w, 3) OVER o AS w3
  FROM (SELECT rid, unnest(words) AS w, unnest(range(len(words))) AS i FROM docs) WINDOW o AS (PARTITION BY rid ORDER BY i)
), places AS (
  SELECT rid, i, CASE WHEN w0 = 'gnu' AND w1 = 'general' AND w2 = 'public' AND w3 = 'license' THEN 'gpl'
                      WHEN w0 = 'apache' AND w1 = 'license' THEN 'apache'
                      WHEN w0 = 'cc' AND w1 = 'by' THEN 'cc-by'
                      WHEN w0 = 'mit' AND w1 = 'license' THEN 'mit' END AS label FROM grams
), texts AS (
  SELECT t, label, {_WORDS.format("text")} AS words FROM (VALUES {_TEXT_ROWS}) v(t, label, text)
), parts AS (
  SELECT t, label, len(words) AS n, j, w AS w0, lead(w) OVER o AS w1, lead(w, 2) OVER o AS w2
  FROM (SELECT t, label, words, unnest(words) AS w, unnest(range(len(words))) AS j FROM texts)
  WINDOW o AS (PARTITION BY t ORDER BY j)
), votes AS (
  SELECT rid, t, label, n, i - j AS diagonal, j FROM grams g JOIN parts p ON g.w0 = p.w0 AND g.w1 = p.w1 AND g.w2 = p.w2
), diagonals AS (
  SELECT rid, t, diagonal, diagonal - lag(diagonal) OVER (PARTITION BY rid, t ORDER BY diagonal) AS apart
  FROM votes GROUP BY rid, t, diagonal HAVING count(*) >= {MIN_VOTES}
), numbered AS (
  SELECT rid, t, diagonal, count(*) FILTER (apart IS NULL OR apart > {MAX_SHIFT}) OVER (PARTITION BY rid, t ORDER BY diagonal) AS span
  FROM diagonals
), spans AS (
  SELECT rid, t, span, any_value(label) AS label, count(DISTINCT j) / (any_value(n) - 2) AS share
  FROM votes JOIN numbered USING (rid, t, diagonal) GROUP BY rid, t, span
  HAVING share >= {MIN_SHARE} AND max(diagonal + j) + 3 - min(diagonal + j) <= {MAX_STRETCH} * any_value(n)
), found AS (
  SELECT rid, label, 1.0::DOUBLE AS share, i FROM places WHERE label IS NOT NULL
  UNION ALL SELECT rid, label, share, NULL FROM spans
), summed AS (
  SELECT rid, count(i) AS n_base, min(i) AS first_word, max(i) AS last_word, max(share) AS score,
         list(DISTINCT label) FILTER (i IS NOT NULL) AS base, list(DISTINCT label) AS every
  FROM found GROUP BY rid
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(every), ','), '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM docs LEFT JOIN summed USING (rid)
"""

OP12 = """
WITH kept AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS same,
         CASE WHEN len(a.v) > 0 THEN list_inner_product(a.v, r.v) ELSE 0 END::BIGINT AS score
  FROM (SELECT * FROM kept WHERE vec_id % 50 = 0) a JOIN kept r ON r.vec_id <> a.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER w AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 3
"""

ORACLE: dict[str, str] = {"op1_substring_dedup": OP1, "op5_mixing": OP5, "op7_line_dedup": OP7,
                          "op11_license_scan": OP11, "op12_hard_negatives": OP12}

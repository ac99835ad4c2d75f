"""DuckDB SQL for the queries that SQL can express."""

NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EXACT = f"""
WITH d AS (SELECT doc_id, {NORM} AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""

MIX = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), keyed AS (
  SELECT *, lpad(length(bin(size))::VARCHAR, 2, '0') || substr(bin(size), 1, 5) AS class,
    floor((('0x' || left(md5('mix:bin:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT / 4294967296.0) * 64)::BIGINT AS bin FROM d
), per AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
weighed AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM per
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, weight, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER (ORDER BY cap / weight, weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighed
), targets AS (
  SELECT *, least(cap::DOUBLE, coalesce((max(CASE WHEN level <= cap / weight THEN level END) OVER ()) * weight, cap::DOUBLE)) AS target,
    ('0x' || left(md5('mix:offset:' || coalesce(source, '')), 8))::BIGINT / 4294967296.0 AS start FROM levels
), ranked AS (
  SELECT k.*, row_number() OVER (PARTITION BY source ORDER BY class, bin, size, doc_id) AS rank FROM keyed k
), crossed AS (
  SELECT r.doc_id, r.source, r.size, t.source_size, t.target, r.rank, t.start,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS ratio
  FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
), counted AS (
  SELECT *, (floor(rank * ratio + start) - floor((rank - 1) * ratio + start))::BIGINT AS copies FROM crossed
)
SELECT doc_id, source, size, source_size, target, copies, copies * size AS taken FROM counted
"""

LINES = r"""
WITH l AS (
  SELECT doc_id, line, i, ('0x' || left(md5(line), 8))::BIGINT AS h
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), cuts AS (
  SELECT l.*, c, coalesce((h + 31 * lag(h) OVER w) % 3 = c, false) AS ends FROM l, range(3) t(c) WINDOW w AS (PARTITION BY doc_id, c ORDER BY i)
), numbered AS (
  SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id, c ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM cuts
), chunks AS (
  SELECT doc_id, c, k, min(i) AS first, count(*) AS lines, string_agg(line, chr(10) ORDER BY i) AS chunk FROM numbered GROUP BY doc_id, c, k
), marked AS (
  SELECT *, lines >= 2 AND (doc_id, first) <> (min((doc_id, first)) OVER (PARTITION BY chunk)) AS gone FROM chunks
), counted AS (
  SELECT doc_id, count(*) AS n_chunks, count(*) FILTER (gone) AS removed_chunks FROM marked GROUP BY doc_id
), dropped AS (
  SELECT DISTINCT n.doc_id, n.i FROM numbered n JOIN marked m ON n.doc_id = m.doc_id AND n.c = m.c AND n.k = m.k WHERE m.gone
), kept AS (
  SELECT l.*, d.i IS NOT NULL AS gone FROM l LEFT JOIN dropped d ON l.doc_id = d.doc_id AND l.i = d.i
), texts AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text, count(*) AS n_lines, count(*) FILTER (gone) AS removed_lines FROM kept GROUP BY doc_id
)
SELECT doc_id, text, n_lines, n_chunks, removed_chunks, removed_lines FROM texts JOIN counted USING (doc_id)
"""

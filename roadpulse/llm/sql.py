"""DuckDB statements for the queries whose whole result SQL can express."""

from __future__ import annotations

_ENDS = "' ' || chr(9) || chr(11) || chr(12) || chr(13)"

ORACLES: dict[str, str] = {
    "op4_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM documents WHERE text IS NOT NULL),
keyed AS (SELECT *, trim(line, {_ENDS}) AS key FROM lines),
counts AS (SELECT source, key, COUNT(DISTINCT doc_id) AS n FROM keyed WHERE key <> '' GROUP BY source, key),
totals AS (SELECT source, COUNT(*) AS n FROM documents GROUP BY source),
bad AS (SELECT c.source, c.key FROM counts c JOIN totals t ON c.source = t.source WHERE c.n >= 5 AND c.n > 0.08::DOUBLE * t.n),
marked AS (SELECT k.*, b.key IS NOT NULL AS dropped FROM keyed k LEFT JOIN bad b ON k.source = b.source AND k.key = b.key)
SELECT doc_id, source, COALESCE(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT dropped), '') AS text, COUNT(*) AS n_lines,
  CAST(SUM(CASE WHEN dropped THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped
FROM marked GROUP BY doc_id, source""",
    "op13_mixing": """
WITH docs AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(COALESCE(text, ''), '[^ \\x09-\\x0D]+')) AS BIGINT) AS size, md5(COALESCE(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
sources AS (
  SELECT source, CAST(SUM(size) AS BIGINT) AS source_size,
    CASE (ROW_NUMBER() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM docs GROUP BY source),
filled AS (
  SELECT *, SUM(source_size) OVER () AS all_size, ROW_NUMBER() OVER w AS k,
    COALESCE(SUM(source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped,
    SUM(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM sources WINDOW w AS (ORDER BY source_size / weight, source IS NULL, source)),
levels AS (SELECT *, (1.5::DOUBLE * all_size - 2.0::DOUBLE * stopped) / open_weight AS level FROM filled),
chosen AS (SELECT arg_min(level, k) AS level FROM levels WHERE weight * level <= 2.0::DOUBLE * source_size),
aims AS (
  SELECT l.source, l.source_size, CASE WHEN c.level IS NULL OR l.weight * c.level > 2.0::DOUBLE * l.source_size THEN 2.0::DOUBLE * l.source_size ELSE l.weight * c.level END AS target
  FROM levels l LEFT JOIN chosen c ON TRUE),
placed AS (
  SELECT d.doc_id, d.size, a.source_size, a.target, CAST(FLOOR(a.target) AS BIGINT) AS budget,
    SUM(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS before_
  FROM docs d JOIN aims a ON d.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + GREATEST(0, LEAST(size, budget % source_size - before_)) END AS BIGINT) AS taken
FROM placed""",
}

"""DuckDB statements of what registered queries return."""

from __future__ import annotations

FAIR_MIX = r"""
WITH sized AS (
  SELECT doc_id,
    CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS place
  FROM documents
), sources AS (
  SELECT key, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY key
), ranked AS (
  SELECT *, CAST(2 * source_size AS DOUBLE) AS cap,
    CASE (row_number() OVER (ORDER BY key) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
    CAST(sum(source_size) OVER () AS BIGINT) AS total
  FROM sources
), filled AS (
  SELECT *, (CAST(total * 150 AS DOUBLE) / 100.0::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
      / sum(weight) OVER (ORDER BY cap / weight, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked
), shares AS (
  SELECT (SELECT level FROM filled WHERE NOT cap <= weight * level ORDER BY cap / weight, key LIMIT 1) AS share
), targets AS (
  SELECT key, source_size, total,
    CASE WHEN cap <= weight * level THEN cap ELSE least(weight * share, cap) END AS target
  FROM filled, shares
), queued AS (
  SELECT s.doc_id, s.key, s.size, s.place, t.source_size, t.target, t.total,
    coalesce(sum(s.size) OVER (PARTITION BY s.key ORDER BY s.place, s.doc_id, s.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized s JOIN targets t USING (key)
), entries AS (
  SELECT doc_id, key, size, total, start + turn * source_size AS start,
    CAST(start + turn * source_size + size AS DOUBLE) / target AS finish
  FROM queued, (VALUES (0), (1)) AS v(turn) WHERE size > 0 AND target > 0
), sorted AS (
  SELECT *, sum(size) OVER (ORDER BY finish, key, start ROWS UNBOUNDED PRECEDING) - size AS before
  FROM entries
), taken AS (
  SELECT doc_id, sum(greatest(0, least(size, total * 150 // 100 - before)))::BIGINT AS taken
  FROM sorted GROUP BY doc_id
)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(t.taken, 0)::BIGINT AS taken
FROM queued q LEFT JOIN taken t USING (doc_id)
"""

ARCHIVES = r"""
WITH rows AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM rows
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id != first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id != first THEN first END AS refers_to
FROM firsts
"""


def url_templates(rules: list[tuple[str, str, str]], depth: int, variety: int) -> str:
    """The URL filter with these rules."""
    hits = "\n".join(
        f"      WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}|{v}'"
        for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r), reverse=True)
    )
    levels = ""
    for k in range(1, depth + 1):
        levels += f"""
), s{k} AS (
  SELECT *, coalesce('/' || string_split(path, '/')[{k + 1}], '') AS segment FROM t{k - 1}
), t{k} AS (
  SELECT host, path, blocked, allowed, template || CASE WHEN segment != '' AND
      (SELECT count(DISTINCT c.segment) FROM s{k} c WHERE c.host = s{k}.host AND c.template = s{k}.template) >= {variety}
    THEN '/*' ELSE segment END AS template
  FROM s{k}"""
    return f"""
WITH split AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest
  FROM pages
), parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM split
), judged AS (
  SELECT *, CASE
{hits}
    END AS hit
  FROM parts
), t0 AS (
  SELECT host, path, count(*) FILTER (hit LIKE '%|block') AS blocked,
    count(*) FILTER (hit LIKE '%|allow') AS allowed, '' AS template
  FROM judged GROUP BY host, path{levels}
), templates AS (
  SELECT host, path, blocked, allowed, template ||
    CASE WHEN len(string_split(path, '/')) > {depth + 1} THEN '/**' ELSE '' END AS template
  FROM t{depth}
), whole AS (
  SELECT (sum(blocked) + 4.0::DOUBLE * 0.5) / (sum(blocked + allowed) + 4.0::DOUBLE) AS p_all FROM templates
), everywhere AS (
  SELECT template, (sum(blocked) + 4.0::DOUBLE * any_value(p_all)) / (sum(blocked + allowed) + 4.0::DOUBLE) AS p_any
  FROM templates, whole GROUP BY template
), own AS (
  SELECT host, template, sum(blocked)::BIGINT AS b, sum(blocked + allowed)::BIGINT AS n
  FROM templates GROUP BY host, template
), hosts AS (
  SELECT *, CAST(sum(b) OVER (PARTITION BY host) AS DOUBLE) / greatest(sum(n) OVER (PARTITION BY host), 1) AS mean
  FROM own
), grouped AS (
  SELECT *, CASE WHEN b - n * mean > 2.0::DOUBLE * sqrt(n * mean * (1.0::DOUBLE - mean)) THEN 'more'
    WHEN b - n * mean < -2.0::DOUBLE * sqrt(n * mean * (1.0::DOUBLE - mean)) THEN 'less' ELSE 'alike' END AS branch
  FROM hosts
), merged AS (
  SELECT *, (sum(b) OVER (PARTITION BY host, branch) + 4.0::DOUBLE * p_any)
    / (sum(n) OVER (PARTITION BY host, branch) + 4.0::DOUBLE) AS purity
  FROM grouped JOIN everywhere USING (template)
)
SELECT j.page_id, j.host, j.path, string_split(j.hit, '|')[1] AS rule,
  coalesce(string_split(j.hit, '|')[2], CASE WHEN m.purity >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
  t.template, m.purity
FROM judged j JOIN templates t USING (host, path) JOIN merged m ON m.host = t.host AND m.template = t.template
"""


#: Every string of 100 bytes of every document, in hexadecimal digits; rows are told by their id.
REPEATED_STRINGS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (
  SELECT doc_id, place, substr(h, 2 * place + 1, 200) AS string
  FROM (SELECT doc_id, h, unnest(range(len(h) // 2 - 99)) AS place FROM d)
),
repeated AS (
  SELECT doc_id, place FROM (
    SELECT doc_id, place, row_number() OVER (PARTITION BY string ORDER BY doc_id, place) AS nth FROM strings
  ) WHERE nth > 1
),
bounds AS (
  SELECT doc_id, place, max(place) OVER (
    PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING
  ) AS before FROM repeated
),
numbered AS (
  SELECT doc_id, place, sum(CASE WHEN before IS NULL OR place > before + 100 THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id ORDER BY place) AS span FROM bounds
),
spans AS (
  SELECT doc_id, span, min(place) AS low, max(place) + 100 AS high FROM numbered GROUP BY doc_id, span
),
kept AS (
  SELECT doc_id, span, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS low, low AS high FROM spans
  UNION ALL
  SELECT doc_id, 1 + max(span), max(high), NULL FROM spans GROUP BY doc_id
),
parts AS (
  SELECT k.doc_id, string_agg(substr(h, 1 + 2 * low::BIGINT, 2 * (coalesce(high, len(h) // 2) - low)::BIGINT), '' ORDER BY span) AS h
  FROM kept k JOIN d ON k.doc_id = d.doc_id GROUP BY k.doc_id
),
gone AS (SELECT doc_id, sum(high - low) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, (len(d.h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
  coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(parts.h, d.h))) AS kept_sha256
FROM d LEFT JOIN gone ON d.doc_id = gone.doc_id LEFT JOIN parts ON d.doc_id = parts.doc_id
"""

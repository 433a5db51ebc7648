"""SQL counterparts of the queries over posts."""

from __future__ import annotations

#: Identity of an id, as DuckDB writes it: full-width digits, blanks and leading zeros don't count.
KEY = "ltrim(regexp_replace(translate(id, '０１２３４５６７８９', '0123456789'), '[\\s\\x{A0}\\x{3000}\\x{200B}-\\x{200D}\\x{2060}\\x{FEFF}]+', '', 'g'), '+0')"

RANKED = f"""
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY collected_at NULLS LAST, hit_id) AS rn
  FROM (SELECT *, {KEY} AS k FROM posts WHERE id IS NOT NULL) WHERE k <> ''
), kept AS (SELECT * FROM ranked WHERE rn = 1)"""

P3_FOUND = f"WITH {RANKED} SELECT hit_id FROM ranked WHERE rn > 1"

TRAILING = f"""
WITH {RANKED},
seen AS (SELECT CAST(created_at AT TIME ZONE 'UTC' AS DATE) AS day, demand, supply FROM kept WHERE created_at IS NOT NULL),
names AS (
  SELECT day, unnest(demand) AS name FROM seen
  UNION ALL
  SELECT day, unnest(supply) AS name FROM seen
), daily AS (SELECT name, day, count(*) AS total FROM names GROUP BY name, day),
days AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day, lo FROM (SELECT min(day) AS lo, max(day) AS hi FROM seen)),
grid AS (
  SELECT c.name, d.day, CAST(d.day - d.lo AS BIGINT) AS n, coalesce(t.total, 0) AS total
  FROM (SELECT DISTINCT unnest(cards) AS name FROM cards) c CROSS JOIN days d
  LEFT JOIN daily t ON t.name = c.name AND t.day = d.day
), totals AS (
  SELECT name, strftime(day, '%Y-%m-%d') AS day, n, CAST(total AS BIGINT) AS total,
    CAST(sum(total) OVER (PARTITION BY name ORDER BY n ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS t7,
    CAST(sum(total) OVER (PARTITION BY name ORDER BY n ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS BIGINT) AS t30
  FROM grid
)"""

P4_TOTALS = f"{TRAILING} SELECT name, day, total, t7, round(t7 / 7.0, 6) AS a7, t30, round(t30 / 30.0, 6) AS a30 FROM totals"

P4_FOUND = f"""{TRAILING}, cases AS (
  SELECT name, day, CASE WHEN t7 >= 20 AND t7 * 30 >= t30 * 14 THEN 'surge' WHEN t7 = 0 AND t30 >= 10 THEN 'lull' END AS kind
  FROM totals WHERE n >= 29
) SELECT name, day, kind FROM cases WHERE kind IS NOT NULL"""

ORACLES = {"p3_found": P3_FOUND, "p4_found": P4_FOUND, "p4_totals": P4_TOTALS}

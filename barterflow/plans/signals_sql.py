"""SQL counterparts of the queries of the engine's own operators."""

from __future__ import annotations

from barterflow.plans.posts_sql import KEY

NOW = "TIMESTAMPTZ '2026-09-28 12:00:00+00'"
SPACE = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def within(hours: int) -> str:
    return f"created_at BETWEEN {NOW} - INTERVAL {hours} HOUR AND {NOW} + INTERVAL 1 HOUR"


COUNTS = f"""
windows(window_key, hours) AS (VALUES ('24h', 24), ('48h', 48), ('168h', 168)),
seen AS (
  SELECT w.window_key, w.hours, p.demand, p.supply FROM posts p JOIN windows w
  ON p.created_at >= {NOW} - to_hours(w.hours) AND p.created_at <= {NOW} + INTERVAL 1 HOUR
), each AS (
  SELECT window_key, unnest(demand) AS name, 1 AS d, 0 AS s FROM seen
  UNION ALL SELECT window_key, unnest(supply) AS name, 0 AS d, 1 AS s FROM seen
), counted AS (
  SELECT window_key, name, CAST(sum(d) AS BIGINT) AS demand, CAST(sum(s) AS BIGINT) AS supply
  FROM each WHERE name IN (SELECT unnest(cards) FROM cards) GROUP BY window_key, name
)"""


def ratio(d: str, s: str, prefix: str) -> str:
    half = f"CAST(floor((CAST({d} AS DOUBLE) / {s}) * 100 + 0.5) AS BIGINT)"
    display = f"CAST({half} // 100 AS VARCHAR) || '.' || lpad(CAST({half} % 100 AS VARCHAR), 2, '0')"
    return f"""CASE WHEN {d} = 0 AND {s} = 0 THEN 0.0 WHEN {s} > 0 THEN round(CAST({d} AS DOUBLE) / {s}, 6) END AS {prefix},
  CASE WHEN {d} = 0 AND {s} = 0 THEN '0.00' WHEN {s} > 0 THEN {display} ELSE '∞' END AS {prefix}_display,
  CASE WHEN {d} = 0 AND {s} = 0 THEN 0.0 WHEN {s} > 0 THEN round(CAST({d} AS DOUBLE) / {s}, 6) ELSE 1000000000.0 + {d} END AS {prefix}_sort"""


def ranked(rows: str) -> str:
    return f"""SELECT window_key, CAST(row_number() OVER (PARTITION BY window_key ORDER BY demand DESC, supply, name) AS BIGINT) AS rank,
  name, demand, supply, {ratio('demand', 'supply', 'ratio')}, demand - supply AS imbalance FROM {rows}"""


def clean(x: str) -> str:
    x = f"regexp_replace(regexp_replace(regexp_replace(replace({x}, chr(160), ' '), '[\\t\\r]+', ' ', 'g'), ' +', ' ', 'g'), '\\n\\n\\n+', chr(10) || chr(10), 'g')"
    return f"regexp_replace(regexp_replace({x}, '^[{SPACE}]+', ''), '[{SPACE}]+$', '')"


ENTRIES = """entries AS (
  SELECT page_id, query, run_id, fetched_at, pos - 1 AS pos, e.id AS id, e.url AS url, e.screenName AS screen_name, e.createdAt AS created_raw, e.displayTextBody AS body
  FROM (SELECT page_id, query, run_id, fetched_at, unnest(timeline.entry) AS e, generate_subscripts(timeline.entry, 1) AS pos FROM timelines)
)"""

STATUS = "regexp_extract(url, '^https?://[^/?#]+/([^/?#]+)/status/([0-9]+)'"
LINK = f"""coalesce(CASE WHEN {STATUS}, 2) <> '' THEN 'https://x.com/' || {STATUS}, 1) || '/status/' || {STATUS}, 2) END,
  CASE WHEN screen_name <> '' THEN 'https://x.com/' || screen_name || '/status/' || id END)"""
ID_MS = "(CAST({key} AS BIGINT) >> 22) + 1288834974657"

PAGING = f"""{ENTRIES},
stamped AS (SELECT page_id, CASE WHEN created_raw > 10000000000 THEN created_raw WHEN created_raw > 0 THEN created_raw * 1000 ELSE {ID_MS.format(key='id')} END AS ms FROM entries),
oldest AS (SELECT page_id, min(ms) AS ms FROM stamped GROUP BY page_id),
c AS (
  SELECT t.page_id, t.query, t.run_id, t.fetched_at, coalesce(len(t.timeline.entry), 0) AS n, o.ms,
    coalesce(nullif(t.timeline.head.oldestTweetId, ''), nullif(t.timeline.entry[len(t.timeline.entry)].id, '')) AS cursor
  FROM timelines t LEFT JOIN oldest o ON o.page_id = t.page_id
), f AS (
  SELECT *, coalesce(ms <= epoch_ms(TIMESTAMPTZ '2026-09-21 12:00:00+00'), false) AS cut,
    cursor IS NOT DISTINCT FROM lag(cursor) OVER (PARTITION BY query, run_id ORDER BY fetched_at, page_id) AS again,
    row_number() OVER (PARTITION BY query, run_id ORDER BY fetched_at, page_id) AS no FROM c
), g AS (SELECT *, NOT cut AND (n = 0 OR cursor IS NULL OR again) AS spent FROM f),
h AS (
  SELECT *, coalesce(max(CASE WHEN cut OR spent THEN 1 ELSE 0 END) OVER (PARTITION BY query, run_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM g
), paged AS (
  SELECT query, run_id, count(*) AS pages, CAST(sum(n) AS BIGINT) AS total_entries, min(ms) AS oldest_ms, bool_or(cut) AS reached_cutoff, bool_or(spent) AS exhausted
  FROM h WHERE ended = 0 AND no <= 10 GROUP BY query, run_id
), jobs AS (SELECT *, NOT reached_cutoff AND NOT exhausted AND pages >= 10 AS capped FROM paged)"""

MENTIONS = "SELECT unnest(demand) AS name FROM posts UNION ALL SELECT unnest(supply) AS name FROM posts"

MARK = f"(?:求む?|希望|譲|出|提供)[{SPACE}]*[:)]"

ORACLES = {
    "name_counts": f"WITH {COUNTS} SELECT window_key, name, demand, supply FROM counted",
    "rank_windows_codepoint": f"WITH {COUNTS} {ranked('counted')}",
    "visible_ranking": f"WITH {COUNTS} {ranked("(SELECT * FROM counted WHERE window_key = '168h' AND name LIKE '%ー%' AND demand + supply >= 1)")}",
    "chart_scale": f"WITH {COUNTS} SELECT greatest(1, max(greatest(demand, supply))) AS scale FROM counted WHERE window_key = '168h'",
    "window_totals": f"""WITH {COUNTS},
n AS (SELECT window_key, count(*) AS posts FROM seen GROUP BY window_key),
t AS (SELECT window_key, CAST(sum(demand) AS BIGINT) AS total_demand, CAST(sum(supply) AS BIGINT) AS total_supply FROM counted GROUP BY window_key),
f AS (SELECT w.window_key, w.hours, coalesce(n.posts, 0) AS posts, coalesce(t.total_demand, 0) AS total_demand, coalesce(t.total_supply, 0) AS total_supply
  FROM windows w LEFT JOIN n ON n.window_key = w.window_key LEFT JOIN t ON t.window_key = w.window_key)
SELECT window_key, hours, posts, total_demand, total_supply, {ratio('total_demand', 'total_supply', 'total_ratio')} FROM f""",
    "retained": f"SELECT hit_id, id FROM posts WHERE id <> '' AND {within(192)}",
    "bag_union": f"SELECT id, CAST(sum(CASE WHEN run_id IS NULL OR run_id % 3 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS copies FROM posts WHERE id <> '' AND {within(192)} GROUP BY id",
    "coverage": f"""SELECT epoch_ms(min(created_at)) AS oldest, epoch_ms(max(created_at)) AS newest, count(*) AS stored, count(DISTINCT id) AS distinct_ids,
  round((epoch_us(max(created_at)) - epoch_us(min(created_at))) / 3600000000.0, 4) AS hours FROM posts WHERE id <> '' AND {within(192)}""",
    "rolling_budget": f"SELECT page_id, query FROM timelines WHERE fetched_at > {NOW} - INTERVAL 24 HOUR AND fetched_at <= {NOW}",
    "stored_posts": """SELECT id, epoch_ms(created_at) AS ms,
  coalesce(array_to_string(list_transform(demand, lambda x: coalesce(x, '-')), '|'), '') AS demand, coalesce(array_to_string(list_transform(supply, lambda x: coalesce(x, '-')), '|'), '') AS supply FROM posts""",
    "source_drilldown": f"""WITH r AS (SELECT * FROM posts WHERE id <> '' AND {within(168)}),
d AS (SELECT id, string_agg(name, '|' ORDER BY name) AS v FROM (SELECT DISTINCT id, unnest(demand) AS name FROM r) WHERE name IS NOT NULL GROUP BY id),
s AS (SELECT id, string_agg(name, '|' ORDER BY name) AS v FROM (SELECT DISTINCT id, unnest(supply) AS name FROM r) WHERE name IS NOT NULL GROUP BY id),
f AS (SELECT id, epoch_ms(min(created_at)) AS ms FROM r GROUP BY id)
SELECT f.id, f.ms, coalesce(d.v, '') AS demand, coalesce(s.v, '') AS supply FROM f LEFT JOIN d ON d.id = f.id LEFT JOIN s ON s.id = f.id""",
    "newest_sources": f"""SELECT id, epoch_ms(min(created_at)) AS ms FROM posts
WHERE id <> '' AND {within(168)} AND (coalesce(list_contains(demand, 'ルモカ'), false) OR coalesce(list_contains(supply, 'ルモカ'), false)) GROUP BY id ORDER BY min(created_at) DESC, id LIMIT 100""",
    "multiset_max": """WITH e AS (SELECT hit_id, 1 AS side, unnest(demand) AS name FROM posts UNION ALL SELECT hit_id, 2 AS side, unnest(supply) AS name FROM posts),
c AS (SELECT hit_id, side, name, count(*) AS n FROM e WHERE name IS NOT NULL GROUP BY hit_id, side, name)
SELECT hit_id, name, max(n) AS n FROM c GROUP BY hit_id, name""",
    "page_entries": f"WITH {ENTRIES} SELECT page_id, pos, id, screen_name, created_raw FROM entries",
    "page_cursors": """SELECT page_id, coalesce(len(timeline.entry), 0) AS entries,
  coalesce(nullif(timeline.head.oldestTweetId, ''), nullif(timeline.entry[len(timeline.entry)].id, '')) AS next_cursor FROM timelines""",
    "last_wins": f"""WITH {ENTRIES} SELECT run_id, query, id, page_id, pos FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id, query, id ORDER BY fetched_at DESC, page_id DESC, pos DESC) AS rn FROM entries) WHERE rn = 1""",
    "name_queries": """WITH n AS (SELECT DISTINCT unnest(cards) AS name FROM cards), a AS (SELECT x.canonical AS canonical, x.alias AS alias FROM (SELECT unnest(aliases) AS x FROM cards)),
u AS (SELECT name AS canonical, name AS search_name FROM n UNION SELECT canonical, alias FROM a WHERE canonical IN (SELECT name FROM n))
SELECT canonical, search_name, 'ポケポケ ' || search_name || ' (求 希望) (譲 出 提供)' AS query FROM u""",
    "highlight_stripped": f"WITH {ENTRIES} SELECT page_id, pos, {clean("regexp_replace(body, chr(9) || '(?:START|END)' || chr(9), '', 'g')")} AS body FROM entries",
    "clean_documents": f"SELECT doc_id, {clean('text')} AS text FROM documents",
    "body_segments": f"""WITH {ENTRIES}, t AS (SELECT page_id, pos, translate({clean("regexp_replace(body, chr(9) || '(?:START|END)' || chr(9), '', 'g')")}, '：﹕）', '::)') AS x FROM entries),
s AS (SELECT page_id, pos, unnest(string_split(regexp_replace(x, '({MARK})', chr(1) || '\\1', 'g'), chr(1))[2:]) AS seg FROM t)
SELECT page_id, pos, CASE WHEN regexp_matches(seg, '^(求|希望)') THEN 'demand' ELSE 'supply' END AS kind, regexp_replace(seg, '^{MARK}', '') AS text FROM s""",
    "entry_links": f"""WITH {ENTRIES}, l AS (SELECT page_id, pos, {LINK} AS link FROM entries)
SELECT page_id, pos, link AS url, nullif(regexp_extract(link, '/status/([0-9]+)', 1), '') AS status_id, nullif(regexp_extract(link, '^https://x.com/([^/]+)/status/', 1), '') AS author FROM l""",
    "entry_times": f"""WITH {ENTRIES} SELECT page_id, pos, CASE WHEN created_raw > 10000000000 THEN created_raw WHEN created_raw > 0 THEN created_raw * 1000
  ELSE {ID_MS.format(key='id')} END AS ms FROM entries""",
    "id_times": f"SELECT hit_id, {ID_MS.format(key='k')} AS ms FROM (SELECT hit_id, nullif({KEY}, '') AS k FROM posts)",
    "query_paging": f"WITH {PAGING} SELECT query, run_id, pages, total_entries, oldest_ms, reached_cutoff, exhausted, capped FROM jobs",
    "backfill_summary": f"""WITH {PAGING}, j AS (SELECT *, query IS NULL OR run_id IS NULL OR run_id % 7 = 0 AS failed FROM jobs)
SELECT count(*) AS attempted, count(*) FILTER (WHERE NOT failed) AS succeeded, count(*) FILTER (WHERE failed) AS failed, count(*) FILTER (WHERE NOT failed AND reached_cutoff) AS cutoff,
  count(*) FILTER (WHERE NOT failed AND exhausted) AS exhausted, count(*) FILTER (WHERE NOT failed AND capped) AS capped, min(oldest_ms) FILTER (WHERE NOT failed) AS oldest_ms,
  count(*) FILTER (WHERE failed) = 0 AND count(*) FILTER (WHERE NOT failed AND capped) = 0 AS complete FROM j""",
    "vector_matches": """WITH e AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
m AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS y FROM e WHERE label IS NOT NULL GROUP BY label, pos),
c AS (SELECT e.vec_id, m.label, corr(CAST(e.x AS DOUBLE), m.y) AS score FROM e JOIN m ON m.pos = e.pos GROUP BY e.vec_id, m.label),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS rank FROM c)
SELECT vec_id AS id, rank, CAST(label AS BIGINT) AS ref, round(score, 5) AS score FROM r WHERE rank <= 2""",
    "catalogue_audit": f"""WITH n AS (SELECT DISTINCT name FROM ({MENTIONS}) WHERE name IS NOT NULL), c AS (SELECT unnest(cards) AS name FROM cards)
SELECT 'unknown' AS finding, name FROM n WHERE name NOT IN (SELECT name FROM c)
UNION ALL SELECT 'extra', name FROM (SELECT DISTINCT name FROM c) WHERE name NOT IN (SELECT name FROM n)
UNION ALL SELECT 'duplicate', name FROM c GROUP BY name HAVING count(*) > 1""",
    "busy_stretches": """WITH d AS (SELECT query, CAST(CAST(created_at AT TIME ZONE 'UTC' AS DATE) - DATE '2026-01-01' AS BIGINT) AS n, count(*) AS hits FROM posts WHERE query IS NOT NULL AND created_at IS NOT NULL GROUP BY 1, 2),
m AS (SELECT query, avg(hits) AS mean FROM d GROUP BY query),
s AS (SELECT d.query, d.n, d.hits / m.mean AS score FROM d JOIN m ON m.query = d.query WHERE d.hits / m.mean >= 1.0),
g AS (SELECT *, n - row_number() OVER (PARTITION BY query ORDER BY n) AS island FROM s)
SELECT query, min(n) AS start, max(n) AS "end", round(avg(score), 6) AS score FROM g GROUP BY query, island HAVING count(*) >= 2""",
}

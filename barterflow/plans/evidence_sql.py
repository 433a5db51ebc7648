"""SQL counterparts of the queries over readings, images, catalogues and sources, and of the queries over parsed text."""

from __future__ import annotations

import unicodedata

from barterflow.plans.posts_sql import KEY
from barterflow.plans.signals_sql import COUNTS, ENTRIES, ID_MS, LINK, MARK, NOW, SPACE, clean, ranked, ratio, within

NAME_CHARS = "ぁ-んァ-ヶー一-龠々"


def nfkc(x: str) -> str:
    """NFKC of characters that become one other, and of marks of several dots; the engine has NFC only."""
    one = {c: unicodedata.normalize("NFKC", c) for c in map(chr, [*range(0xA0, 0xD800), *range(0xF900, 0x10000)])}
    one = {c: d for c, d in one.items() if c != d and len(d) == 1 and d != "'"}
    return f"nfc_normalize(replace(replace(translate({x}, '{''.join(one)}', '{''.join(one.values())}'), '…', '...'), '‥', '..'))"


#: Every printable ASCII character but the quote: the engine's levenshtein counts bytes, so the characters of two texts are renamed to these.
BYTES = "".join(chr(c) for c in range(33, 127) if chr(c) != "'")


def edits(a: str, b: str) -> str:
    return f"levenshtein(translate({a}, {a} || {b}, '{BYTES}'), translate({b}, {a} || {b}, '{BYTES}'))"


def joined(names: str) -> str:
    return f"coalesce(array_to_string(list_sort(list_filter({names}, lambda x: x IS NOT NULL)), '|'), '')"


NAMES = "names AS (SELECT DISTINCT name FROM (SELECT unnest(cards) AS name FROM cards) WHERE name <> '')"
ALIASES = "aliased AS (SELECT a.alias AS alias, a.canonical AS canonical FROM (SELECT unnest(aliases) AS a FROM cards) WHERE a.alias <> '')"


def mentioned(keys: str) -> str:
    """CTEs after ``segs`` (keys, kind, seg): ``sides``: keys, kind, name, n of each mention of a name in a segment."""
    return f"""{NAMES},
canon AS (SELECT {keys}, kind, list_reduce((SELECT list_transform(list_filter(aliases, lambda a: a.alias <> ''), lambda a: a.alias || chr(1) || a.canonical) FROM cards),
  lambda t, a: replace(t, split_part(a, chr(1), 1), split_part(a, chr(1), 2)), seg) AS t FROM segs),
tails AS (SELECT {keys}, kind, name, unnest(list_transform(list_filter(range(1, length(t) + 1), lambda p: substring(t, p, length(name)) = name AND NOT regexp_matches(substring(t, p + length(name), 1), '[{NAME_CHARS}]')),
  lambda p: substring(t, p + length(name), 12))) AS tail FROM canon JOIN names ON contains(t, name)),
figures AS (SELECT {keys}, kind, name, regexp_replace(regexp_extract(tail, '^[{SPACE}]*(?:[×xX＊*][{SPACE}]*([0-9]+)|([0-9]+)[{SPACE}]*枚)', 1) || regexp_extract(tail, '^[{SPACE}]*(?:[×xX＊*][{SPACE}]*([0-9]+)|([0-9]+)[{SPACE}]*枚)', 2), '^0+', '') AS f FROM tails),
sides AS (SELECT {keys}, kind, name, CASE WHEN length(f) > 2 THEN 20 WHEN f = '' THEN 1 ELSE least(20, CAST(f AS INT)) END AS n FROM figures)"""


def side(kind: str, of: str = "n") -> str:
    """Sorted text of the names of one side, each as often as it counts."""
    return f"coalesce(array_to_string(list_sort(flatten(list(list_transform(range({of}), lambda i: name)) FILTER (WHERE kind = '{kind}'))), '|'), '') AS {kind}"


STRIPPED = clean("regexp_replace(coalesce(body, ''), chr(9) || '(?:START|END)' || chr(9), '', 'g')")
FOUND = f"coalesce(regexp_matches(replace({clean("regexp_replace(body, chr(9) || '(?:START|END)' || chr(9), '', 'g')")}, '複数可ではない', ' '), '複数可|お返事おそめ'), false)"
TIME = f"CASE WHEN created_raw > 10000000000 THEN created_raw WHEN created_raw > 0 THEN created_raw * 1000 ELSE {ID_MS.format(key='id')} END"


def parsed(rows: str) -> str:
    """CTEs ``paired`` (page_id, pos of bodies with both headings) and ``lists`` (page_id, pos, demand, supply) of ``rows`` of entries."""
    return f"""read AS (SELECT *, {TIME} AS ms, {LINK} AS link, translate({STRIPPED}, '：﹕）', '::)') AS x FROM {rows} WHERE id <> '' AND {TIME} IS NOT NULL),
cut AS (SELECT page_id, pos, unnest(string_split(regexp_replace(x, '({MARK})', chr(1) || '\\1', 'g'), chr(1))[2:]) AS s FROM read),
every AS (SELECT page_id, pos, CASE WHEN regexp_matches(s, '^(求|希望)') THEN 'demand' ELSE 'supply' END AS kind, regexp_replace(s, '^{MARK}', '') AS seg FROM cut),
paired AS (SELECT page_id, pos FROM every GROUP BY page_id, pos HAVING count(DISTINCT kind) = 2),
segs AS (SELECT e.* FROM every e JOIN paired b ON b.page_id = e.page_id AND b.pos = e.pos), {mentioned('page_id, pos')},
lists AS (SELECT page_id, pos, {side('demand')}, {side('supply')} FROM sides GROUP BY page_id, pos)"""


VARIANTS = f"""{NAMES}, {ALIASES},
raw AS (SELECT name AS raw, name AS canonical FROM names UNION ALL SELECT alias, canonical FROM aliased WHERE canonical IN (SELECT name FROM names)),
variants AS (SELECT DISTINCT regexp_replace(translate(raw, '―−‐‑–—', 'ーーーーーー'), '[^{NAME_CHARS}]', '', 'g') AS normalized, canonical FROM raw)"""
PARTS = SPACE + r"，,，.。:：;；/／\\|｜()\[\]{}【】「」『』<>＜＞" + '"' + r"''`´^~_+=*×xX"


def title(x: str) -> str:
    return f"regexp_replace(translate({x}, '―−‐‑–—', 'ーーーーーー'), '[^{NAME_CHARS}]', '', 'g')"


def titles(passes: str) -> str:
    """CTEs from ``passes`` (cell_id, pass, plain, confidence) to ``votes``."""
    return f"""{VARIANTS},
lines AS (SELECT cell_id, pass, confidence, unnest(regexp_split_to_array(plain, '\\r?\\n')) AS line FROM {passes}),
tokens AS (SELECT DISTINCT cell_id, pass, confidence, token FROM (
  SELECT cell_id, pass, confidence, {title('line')} AS token FROM lines
  UNION ALL SELECT cell_id, pass, confidence, {title('part')} FROM (SELECT cell_id, pass, confidence, unnest(regexp_split_to_array(line, '[{PARTS}]+')) AS part FROM lines)
) WHERE length(token) >= 2),
words AS (SELECT DISTINCT token FROM tokens),
near AS (SELECT token, canonical, length(normalized) AS len, {edits('token', 'normalized')} AS distance, length(token) AS own FROM words JOIN variants
  ON length(normalized) > 3 AND abs(length(token) - length(normalized)) <= 2 AND token <> normalized),
fits AS (
  SELECT token, canonical, length(normalized) AS len, true AS exact, 0 AS distance, 1.0 AS score FROM words JOIN variants ON token = normalized
  UNION ALL SELECT token, canonical, len, false, distance, 1 - distance / CAST(greatest(own, len) AS DOUBLE) FROM near WHERE distance <= CASE WHEN len >= 10 THEN 2 ELSE 1 END
    AND 1 - distance / CAST(greatest(own, len) AS DOUBLE) >= CASE WHEN len >= 10 THEN 0.86 WHEN len >= 6 THEN 0.88 ELSE 0.80 END
), met AS (SELECT *, row_number() OVER (PARTITION BY cell_id, pass, canonical ORDER BY exact DESC, distance, score DESC, confidence DESC, len DESC) AS rn FROM tokens JOIN fits USING (token)),
one AS (SELECT *, row_number() OVER w AS place, lead(exact) OVER w AS exact2, lead(distance) OVER w AS distance2, lead(score) OVER w AS score2 FROM met WHERE rn = 1
  WINDOW w AS (PARTITION BY cell_id, pass ORDER BY exact DESC, distance, score DESC, confidence DESC, len DESC, canonical)),
best AS (SELECT cell_id, pass, canonical, exact, distance, score, confidence FROM one WHERE place = 1 AND NOT coalesce(exact = exact2 AND distance = distance2 AND abs(score - score2) < 0.08, false)),
votes AS (SELECT cell_id, canonical, count(*) AS votes, count(*) FILTER (WHERE exact) AS exact_votes, round(avg(score), 12) AS avg_score, round(avg(confidence), 12) AS avg_confidence, CAST(min(distance) AS BIGINT) AS best_distance FROM best GROUP BY cell_id, canonical)"""


AGREED = f"""placed AS (SELECT *, row_number() OVER w AS place, coalesce(lead(votes) OVER w, 0) AS votes2, coalesce(lead(exact_votes) OVER w, 0) AS exact2, lead(avg_score) OVER w AS score2, length({title('canonical')}) AS len FROM votes
  WINDOW w AS (PARTITION BY cell_id ORDER BY exact_votes DESC, votes DESC, avg_score DESC, avg_confidence DESC, best_distance, canonical COLLATE ja, canonical)),
agreed AS (SELECT cell_id, canonical FROM placed WHERE place = 1 AND CASE WHEN exact_votes > 0 THEN exact_votes >= CASE WHEN len <= 3 THEN 3 ELSE 2 END AND NOT (exact2 > 0 AND exact2 >= exact_votes - 1)
  ELSE votes >= CASE WHEN best_distance >= 2 THEN 4 ELSE 3 END AND votes2 < votes AND NOT coalesce(votes2 = votes - 1 AND abs(avg_score - score2) < 0.08, false) END)"""

CELLS = """cells AS (SELECT hit_id, coalesce(demand[1], supply[1]) AS base, coalesce(supply[1], '') AS other, unnest(range(5)) AS pass FROM posts),
passes AS (SELECT hit_id AS cell_id, CAST(pass AS INT) AS pass, [base, base, substring(base, 1, length(base) - 1), base || ' ×2', base || '枚', substring(base, 2), base || chr(10) || other][(hit_id + pass) % 7 + 1] AS plain,
  ((hit_id * 7 + pass * 13) % 100) / 100.0 AS confidence FROM cells WHERE base IS NOT NULL)"""

SHEETS = f"""passes AS (SELECT id AS url, hit_id, hit_id % 4 <> 0 AS star, list_filter(demand, lambda x: x IS NOT NULL) AS d, list_filter(supply, lambda x: x IS NOT NULL) AS s FROM posts WHERE id <> ''),
written AS (SELECT url, hit_id, star, CASE hit_id % 5
  WHEN 0 THEN '求 ' || coalesce(array_to_string(d, '、'), '') || chr(10) || '譲 ' || coalesce(array_to_string(s, '、'), '')
  WHEN 1 THEN '欲しぃカ一ド' || chr(10) || coalesce(array_to_string(d, chr(10)), '') || chr(10) || '譲れろ力ード】' || coalesce(array_to_string(s, '|'), '')
  WHEN 2 THEN '希望 ' || coalesce(array_to_string(d, '×2、'), '')
  WHEN 3 THEN '出: ' || coalesce(array_to_string(s, ' 3枚 '), '')
  ELSE coalesce(array_to_string(d, '、'), '') END AS t FROM passes),
m1 AS (SELECT url, hit_id, star, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[カ力][一ー―−-]ド', 'カード', 'g'), '欲し[ぃい]', '欲しい', 'g'), '出せ[るろ]', '出せる', 'g'), '譲れ[るろ]', '譲れる', 'g'), '[｜|¦]', ' ', 'g') AS t FROM written),
m2 AS (SELECT url, hit_id, star, regexp_replace(regexp_replace(replace(translate(t, '：﹕', '::'), '／', '/'), '[・•●]', ' ', 'g'), '([{NAME_CHARS}])[ \\t]+([{NAME_CHARS}])', '\\1\\2', 'g') AS t FROM m1),
m3 AS (SELECT url, hit_id, star, regexp_replace(regexp_replace(regexp_replace(t, '([{NAME_CHARS}])[ \\t]+([{NAME_CHARS}])', '\\1\\2', 'g'), '\\n[ \\t]+', chr(10), 'g'), '[ \\t][ \\t]+', ' ', 'g') AS t FROM m2),
m4 AS (SELECT url, hit_id, star, {clean('t')} AS t FROM m3)"""
IMAGE_MARK = rf"(?:欲しいカード|ほしいカード|求めるカード|希望カード|求む|求|希望|出せるカード|譲れるカード|提供カード|譲|出|提供)[{SPACE}]*(?::|\)|）|】|\]|$)?"

IMAGES = """ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hit_id) AS place FROM posts WHERE id <> ''),
of AS (SELECT *, bool_or(hit_id % 3 = 0) OVER (PARTITION BY id) AS alone FROM ranked WHERE place <= 4),
used AS (SELECT * FROM of WHERE NOT alone OR hit_id % 3 = 0),
listed AS (SELECT id, hit_id, 'demand' AS kind, unnest(demand) AS name FROM used UNION ALL SELECT id, hit_id, 'supply', unnest(supply) FROM used),
most AS (SELECT id, kind, name, max(n) AS n FROM (SELECT id, hit_id, kind, name, count(*) AS n FROM listed WHERE name IS NOT NULL GROUP BY ALL) GROUP BY ALL)"""


DECIDED = """e AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
means AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS y FROM e WHERE label IS NOT NULL GROUP BY label, pos),
c AS (SELECT e.vec_id, m.label, corr(CAST(e.x AS DOUBLE), m.y) AS score FROM e JOIN means m ON m.pos = e.pos GROUP BY e.vec_id, m.label),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 12) DESC, label) AS rank FROM c),
two AS (SELECT vec_id AS id, max('L' || label) FILTER (WHERE rank = 1) AS best, max(score) FILTER (WHERE rank = 1) AS s1, max(score) FILTER (WHERE rank = 2) AS s2 FROM r GROUP BY vec_id),
asked AS (SELECT t.*, s1 - coalesce(s2, 0.0) AS lead_, CASE t.id % 3 WHEN 1 THEN 'L' || v.label WHEN 2 THEN 'L' || (v.label % 9) END AS ocr FROM two t JOIN embeddings v ON v.vec_id = t.id),
decided AS (SELECT id, best, lead_, CASE WHEN best IS NULL THEN 'no-image-match' WHEN ocr <> best THEN 'image-ocr-conflict' WHEN ocr IS NULL AND s1 >= 0.3 AND lead_ >= 0.055 THEN 'image-strong'
  WHEN ocr = best AND s1 >= 0.2 AND lead_ >= 0.035 THEN 'image+ocr' ELSE 'image-not-confident' END AS reason FROM asked),
d AS (SELECT id, CASE WHEN reason IN ('image-strong', 'image+ocr') THEN best END AS card, reason, lead_ FROM decided)"""

PRINTS = """prints AS (SELECT p_partkey AS id, p_brand AS name, p_type AS type, p_size > 25 AS big, p_partkey % 3 AS r, p_name AS set_code,
  CASE WHEN p_partkey % 5 <> 0 THEN 'img/' || p_partkey WHEN p_partkey % 10 = 0 THEN 'alt/' || p_partkey END AS image FROM part),
chosen AS (SELECT * FROM prints WHERE type = 'PROMO' AND big AND r = 1),
map AS (SELECT en, CASE WHEN en LIKE '%7' THEN NULL WHEN en LIKE '%3' THEN '和' || left(en, length(en) - 1) || '1' ELSE '和' || en END AS ja FROM (SELECT DISTINCT p_brand AS en FROM part)),
named AS (SELECT DISTINCT ja AS name FROM map WHERE ja IS NOT NULL AND ja NOT LIKE '%4'),
configured AS (SELECT name FROM named UNION ALL SELECT name FROM named WHERE name LIKE '%2' UNION ALL VALUES ('和余り'), ('和余り2')),
expected AS (SELECT DISTINCT ja AS name FROM map WHERE ja IS NOT NULL AND en IN (SELECT name FROM chosen)),
findings AS (
  SELECT 'unknown' AS finding, en AS name FROM map WHERE ja IS NULL AND en IN (SELECT name FROM chosen)
  UNION ALL SELECT 'missing', name FROM expected WHERE name NOT IN (SELECT name FROM configured)
  UNION ALL SELECT DISTINCT 'extra', name FROM configured WHERE name NOT IN (SELECT name FROM expected)
  UNION ALL SELECT 'duplicate', name FROM configured GROUP BY name HAVING count(*) > 1
)"""

PITCH = "CASE WHEN l_linenumber <> 7 THEN l_quantity * 3 - 3 END"

PRINTED = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS e FROM embeddings),
g AS (SELECT vec_id, label, list_transform(range(576), lambda i: (CAST(floor(e[i % 64 + 1] * 900) AS BIGINT) + i * (vec_id % 3)) % 256) AS g,
  list_transform(range(432), lambda i: (CAST(floor(e[(i * 5) % 64 + 1] * 1200) AS BIGINT) + i) % 256) AS c FROM v),
f AS (SELECT vec_id, label, g, c, flatten(list_transform(range(529), lambda k: [least(255, abs(g[(k // 23) * 24 + k % 23 + 2] - g[(k // 23) * 24 + k % 23 + 1]) * 3), least(255, abs(g[(k // 23 + 1) * 24 + k % 23 + 1] - g[(k // 23) * 24 + k % 23 + 1]) * 3)])) AS d FROM g),
z AS (SELECT vec_id, label, list_transform(g, lambda x: CAST(x - ga AS DOUBLE)) AS g, list_transform(d, lambda x: CAST(x - da AS DOUBLE)) AS d, c FROM (SELECT *, list_avg(g) AS ga, list_avg(d) AS da FROM f)),
refs AS (SELECT 'L' || label AS canonical, g, d, c FROM z WHERE vec_id IN (SELECT min(vec_id) FROM embeddings WHERE label IS NOT NULL GROUP BY label)),
s AS (SELECT z.vec_id, r.canonical, least(1, greatest(0, (list_cosine_similarity(z.g, r.g) + 1) / 2 * 0.5 + (list_cosine_similarity(z.d, r.d) + 1) / 2 * 0.32
  + (1 - least(1, list_avg(list_transform(range(1, 433), lambda i: abs(z.c[i] - r.c[i]))) / 255)) * 0.18)) AS score FROM z, refs r),
placed AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 12) DESC, canonical) AS rank FROM s)"""

ORACLES = {
    "rank_windows": f"""WITH {COUNTS} SELECT window_key, CAST(row_number() OVER (PARTITION BY window_key ORDER BY demand DESC, supply, name COLLATE ja, name) AS BIGINT) AS rank,
  name, demand, supply, {ratio('demand', 'supply', 'ratio').replace('round(CAST(demand AS DOUBLE) / supply, 6)', 'CAST(demand AS DOUBLE) / supply')}, demand - supply AS imbalance FROM counted""",
    "fuzzy_names": f"""WITH {NAMES}, other AS (SELECT DISTINCT other FROM (SELECT unnest(demand) AS other FROM posts UNION ALL SELECT unnest(supply) FROM posts) WHERE other <> '' AND other NOT IN (SELECT name FROM names))
SELECT other, name, CAST({edits('other', 'name')} AS BIGINT) AS distance FROM other, names WHERE {edits('other', 'name')} <= 6""",
    "parsed_posts": f"""WITH {ENTRIES}, {parsed('entries')}
SELECT r.page_id, r.pos, r.id, r.ms, r.link AS url, r.screen_name AS author, l.demand, l.supply FROM read r JOIN lists l ON l.page_id = r.page_id AND l.pos = r.pos WHERE r.link IS NOT NULL""",
    "title_consensus": f"""WITH {ENTRIES}, passes AS (SELECT screen_name AS cell_id, page_id || '-' || pos AS pass, {nfkc('body')} AS plain, 0.0 AS confidence FROM entries WHERE screen_name IS NOT NULL),
{titles('passes')}, {AGREED} SELECT cell_id, canonical FROM agreed""",
    "unnegated_bodies": f"WITH {ENTRIES} SELECT page_id, pos, {FOUND} AS found FROM entries",
    "trade_images": f"""WITH {ENTRIES} SELECT page_id, pos, (regexp_matches(coalesce(body, ''), '求|希望') AND regexp_matches(coalesce(body, ''), '譲|出|提供')) OR coalesce(regexp_matches(url, 'x\\.com/a|example\\.org'), false) AS likely FROM entries""",
    "star_marks": f"""SELECT hit_id, regexp_matches({nfkc("coalesce(query, '') || ' ' || ['★2', '☆☆', '星 ２', '2 Stars', '★3', '☆'][hit_id % 6 + 1]")}, '(?i)(?:★|☆)[{SPACE}]*2|☆☆|星[{SPACE}]*2|2[{SPACE}]*(?:star|stars)') AS marked FROM posts""",
    "reused_entries": f"""WITH {ENTRIES}, k AS (SELECT id, demand, supply, row_number() OVER (PARTITION BY id ORDER BY created_at, hit_id) AS rn FROM posts WHERE id <> '' AND created_at IS NOT NULL)
SELECT e.page_id, e.pos, k.id IS NOT NULL AND NOT {FOUND} AS reused, CASE WHEN k.demand IS NOT NULL THEN {joined('k.demand')} END AS demand, CASE WHEN k.supply IS NOT NULL THEN {joined('k.supply')} END AS supply
FROM entries e LEFT JOIN k ON k.id = e.id AND k.rn = 1""",
    "recognitions": f"""WITH {ENTRIES}, c AS (SELECT id AS url, count(*) AS passes, max(collected_at) AS checked_at, min(hit_id) % 3 AS v FROM posts WHERE id <> '' GROUP BY id),
u AS (SELECT DISTINCT id AS url FROM entries WHERE id IS NOT NULL), k AS (SELECT * FROM c WHERE v = 1 AND checked_at > {NOW} - INTERVAL 2592 HOUR)
SELECT u.url, coalesce(k.passes, length(u.url)) AS passes, k.url IS NOT NULL AS reused FROM u LEFT JOIN k ON k.url = u.url""",
    "image_counts": """SELECT count(*) AS images, count(*) FILTER (WHERE hit_id % 3 = 0) AS layout, count(query) AS explicit, count(*) FILTER (WHERE len(demand) > 0) AS with_demand, count(*) FILTER (WHERE len(supply) > 0) AS with_supply,
  CAST(sum(hit_id % 5) AS BIGINT) AS passes, count(*) FILTER (WHERE author IS NULL) AS failed, count(*) FILTER (WHERE hit_id % 4 <> 0) AS new_images, count(*) FILTER (WHERE hit_id % 4 = 0) AS cache_hits, CAST(sum(hit_id % 100) AS BIGINT) AS millis FROM posts""",
    "read_sheets": f"""WITH {SHEETS},
cut AS (SELECT url, hit_id, unnest(string_split(regexp_replace(t, '({IMAGE_MARK})', chr(1) || '\\1', 'gm'), chr(1))[2:]) AS s FROM m4),
segs AS (SELECT url, hit_id, CASE WHEN regexp_matches(s, '^(欲しい|ほしい|求|希望)') THEN 'demand' ELSE 'supply' END AS kind, regexp_replace(s, '^{IMAGE_MARK}', '', 'm') AS seg FROM cut),
{mentioned('url, hit_id')},
usable AS (SELECT url FROM passes GROUP BY url HAVING bool_or(star)),
total AS (SELECT url, kind, name, max(n) AS n FROM (SELECT url, hit_id, kind, name, CAST(sum(n) AS BIGINT) AS n FROM sides GROUP BY ALL) WHERE url IN (SELECT url FROM usable) GROUP BY ALL),
lists AS (SELECT url, {side('demand')}, {side('supply')} FROM total GROUP BY url)
SELECT u.url, l.url IS NOT NULL AS explicit, coalesce(demand, '') AS demand, coalesce(supply, '') AS supply FROM (SELECT DISTINCT url FROM passes) u LEFT JOIN lists l ON l.url = u.url""",
    "image_evidence": f"""WITH {IMAGES},
lists AS (SELECT id, {side('demand')}, {side('supply')} FROM most GROUP BY id),
n AS (SELECT id, CAST(count(*) AS INT) AS image_count, bool_or(alone) AS authoritative, bool_or((NOT alone OR hit_id % 3 = 0) AND demand IS NOT NULL) AS said FROM of GROUP BY id)
SELECT n.id, coalesce(demand, '') AS demand, coalesce(supply, '') AS supply, said AND l.id IS NOT NULL AS explicit, image_count, authoritative FROM n LEFT JOIN lists l ON l.id = n.id""",
    "posts_with_images": f"""WITH {ENTRIES}, fine AS (SELECT * FROM entries WHERE NOT {FOUND}), {parsed('fine')},
{IMAGES}, n AS (SELECT id, CAST(count(*) AS INT) AS image_count, bool_or(alone) AS authoritative, bool_or((NOT alone OR hit_id % 3 = 0) AND demand IS NOT NULL) AND id IN (SELECT id FROM most) AS said FROM of GROUP BY id),
t AS (SELECT r.page_id, r.pos, r.id, b.page_id IS NOT NULL AS explicit FROM read r LEFT JOIN paired b ON b.page_id = r.page_id AND b.pos = r.pos),
own AS (SELECT page_id, pos, kind, name, CAST(sum(n) AS BIGINT) AS n FROM sides GROUP BY ALL),
parts AS (
  SELECT t.page_id, t.pos, m.kind, m.name, m.n FROM t JOIN most m ON m.id = t.id
  UNION ALL SELECT o.page_id, o.pos, o.kind, o.name, o.n FROM own o JOIN t ON t.page_id = o.page_id AND t.pos = o.pos LEFT JOIN n ON n.id = t.id WHERE NOT coalesce(n.authoritative, false)
), most_of AS (SELECT page_id, pos, kind, name, max(n) AS n FROM parts GROUP BY ALL),
sums AS (SELECT page_id, pos, {side('demand')}, {side('supply')} FROM most_of GROUP BY page_id, pos),
f AS (SELECT t.*, coalesce(n.authoritative, false) AS authoritative, coalesce(n.said, false) AS said, coalesce(n.image_count, 0) AS image_count FROM t LEFT JOIN n ON n.id = t.id)
SELECT f.page_id, f.pos, f.id, s.demand, s.supply, CASE WHEN authoritative THEN 'layout-image' WHEN explicit AND said THEN 'text+image' WHEN said THEN 'image' ELSE 'text' END AS parsed_from, image_count, authoritative
FROM f JOIN sums s ON s.page_id = f.page_id AND s.pos = f.pos WHERE CASE WHEN authoritative THEN said ELSE explicit OR said END""",
    "title_readings": f"WITH {CELLS}, {titles('passes')} SELECT cell_id, pass, canonical, exact, CAST(distance AS BIGINT) AS distance, round(score, 6) AS score, confidence FROM best",
    "title_votes": f"WITH {CELLS}, {titles('passes')} SELECT cell_id, canonical, votes, exact_votes, round(avg_score, 6) AS avg_score, round(avg_confidence, 6) AS avg_confidence, best_distance FROM votes",
    "agreed_titles": f"WITH {CELLS}, {titles('passes')}, {AGREED} SELECT cell_id, canonical FROM agreed",
    "badge_votes": """WITH p AS (SELECT hit_id, unnest(range(3 + 2 * (hit_id % 2))) AS pass FROM posts),
r AS (SELECT hit_id, ['2', '12', '1', '', '3', '2', '21'][(hit_id * 3 + pass) % 7 + 1] AS d FROM p),
c AS (SELECT hit_id, count(*) AS n, count(*) FILTER (WHERE contains(d, '2')) AS yes, count(*) FILTER (WHERE NOT contains(d, '2') AND regexp_matches(d, '[13]')) AS no FROM r GROUP BY hit_id)
SELECT hit_id AS cell_id, (hit_id % 50) / 100.0 >= 0.18 AND (hit_id % 9) / 1000.0 >= 0.0025 AND CASE WHEN n >= 5 THEN yes >= 3 AND yes - no >= 2 ELSE yes >= 2 AND yes - no >= 1 END AS verified FROM c""",
    "shown_cells": "SELECT l_orderkey, l_linenumber, (l_quantity / 12 >= 2.2 AND l_discount * 200 >= 10) OR (l_extendedprice / 15000 >= 3.2 AND l_tax * 400 >= 18) AS shown FROM lineitem",
    "card_decisions": f"WITH {DECIDED} SELECT id, card, reason, round(lead_, 5) AS margin FROM d",
    "cell_counts": f"""WITH {DECIDED} SELECT count(*) AS cells, count(DISTINCT id // 10) AS images, count(*) FILTER (WHERE card IS NOT NULL AND id % 4 <> 0) AS matched, count(*) FILTER (WHERE id % 4 <> 0) AS verified,
  count(*) FILTER (WHERE card IS NOT NULL AND id % 4 = 0) AS rejected_rarity, count(*) FILTER (WHERE reason = 'image-strong') AS strong, count(*) FILTER (WHERE reason = 'image+ocr') AS agreed,
  count(*) FILTER (WHERE reason = 'image-ocr-conflict') AS conflict, count(*) FILTER (WHERE reason = 'image-not-confident') AS uncertain FROM d""",
    "fingerprint_matches": f"WITH {PRINTED} SELECT CAST(vec_id AS VARCHAR) AS id, CAST(rank AS INT) AS rank, canonical, round(score, 5) AS score FROM placed WHERE rank <= 2",
    "grid_layouts": f"""WITH m AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 50 AS h, {PITCH} AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(CASE WHEN h IS NULL OR c IS NULL OR h <= 0 OR c <= 0 OR c * 1.36 <= 0 THEN 0 WHEN h < c * 1.02 + 14 THEN 0
  ELSE greatest(1, least(12, floor((h - c * CAST(1.02 AS DOUBLE) - 1) / (c * CAST(1.36 AS DOUBLE))) + 1)) END AS INT) AS rows FROM m""",
    "run_spans": """WITH s AS (SELECT query, run_id, (epoch_us(max(created_at)) - epoch_us(min(created_at))) / 3.6e9 AS hours FROM posts WHERE created_at IS NOT NULL GROUP BY query, run_id)
SELECT query, run_id, CASE WHEN hours < 48 THEN CAST(CAST(floor(hours + 0.5) AS INT) AS VARCHAR) || 'h' ELSE format('{:.1f}', hours / 24) || 'd' END AS span FROM s""",
    "print_counts": f"WITH {PRINTS} SELECT name, min(id) AS first_id, min_by(set_code, id) AS first_set, count(*) AS prints FROM chosen GROUP BY name",
    "translated_audit": f"WITH {PRINTS} SELECT finding, name FROM findings",
    "audit_report": f"""WITH {PRINTS}, k(no, kind) AS (VALUES (1, 'unknown'), (2, 'missing'), (3, 'extra'), (4, 'duplicate')),
l AS (SELECT no, '- ' || kind || ': ' || coalesce(string_agg(name, ', ' ORDER BY name), 'none') AS line FROM k LEFT JOIN findings ON finding = kind GROUP BY no, kind) SELECT string_agg(line, chr(10) ORDER BY no) AS report FROM l""",
    "catalogue_references": f"""WITH {PRINTS}, old AS (SELECT id, CASE WHEN id % 6 = 0 THEN 'img/old' ELSE 'img/' || id END AS image, name, set_code FROM prints WHERE id % 2 = 0)
SELECT CAST(c.id AS VARCHAR) AS id, c.name AS english_name, m.ja AS canonical, c.image, o.name AS gray, o.set_code AS color FROM chosen c JOIN map m ON m.en = c.name LEFT JOIN old o ON o.id = c.id AND o.image = c.image
WHERE c.image IS NOT NULL AND m.ja IN (SELECT name FROM configured)""",
    "page_quotas": f"""WITH RECURSIVE q AS (SELECT query, row_number() OVER (ORDER BY pos) AS i, count(*) OVER () AS n FROM search_queries),
day AS (SELECT greatest(0, 72 - count(*)) AS left_ FROM timelines WHERE fetched_at > {NOW} - INTERVAL 24 HOUR AND fetched_at <= {NOW}),
turn AS (SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS pages, CAST(least(12, left_) AS BIGINT) AS quota FROM day
  UNION ALL SELECT t.i + 1, p, t.quota - p FROM (SELECT t.i, t.quota, CASE WHEN t.quota <= 0 THEN 0 ELSE least(5, greatest(1, t.quota - (q.n - q.i))) END AS p FROM turn t JOIN q ON q.i = t.i + 1) t)
SELECT q.query, t.pages FROM turn t JOIN q ON q.i = t.i""",
    "newest_posts": "SELECT hit_id, epoch_ms(created_at) AS ms FROM posts ORDER BY created_at DESC NULLS LAST, hit_id LIMIT 100",
    "image_links": f"""WITH {ENTRIES} SELECT page_id, pos, 'http://example.org/' || id || ' https://pbs.twimg.com/media/' || id || '?format=jpg&name=orig https://example.org/' || id || '.PNG?x=1' AS links FROM entries""",
    "json_round_trip": f"WITH {ENTRIES} SELECT page_id, pos, id, body FROM entries",
    "published_snapshot": f"""WITH {COUNTS}, r AS ({ranked('counted').replace('supply, name)', 'supply, name COLLATE ja, name)')}), p AS (SELECT window_key, count(*) AS posts FROM seen GROUP BY window_key)
SELECT (SELECT count(*) FROM (SELECT DISTINCT unnest(cards) FROM cards)) AS cards, (SELECT count(*) FROM posts WHERE id <> '' AND {within(192)}) AS stored, r.window_key, p.posts,
  CAST(sum(r.demand) OVER (PARTITION BY r.window_key) AS BIGINT) AS total_demand, r.rank, r.name, r.demand, r.supply, r.ratio_display FROM r JOIN p ON p.window_key = r.window_key""",
    "streamed_posts": f"""WITH {ENTRIES}, last AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY run_id, query, id ORDER BY fetched_at DESC, page_id DESC, pos DESC) AS rn FROM entries) WHERE rn = 1), {parsed('last')}
SELECT r.run_id, r.query, r.id, r.ms, l.demand, l.supply FROM read r JOIN lists l ON l.page_id = r.page_id AND l.pos = r.pos WHERE r.link IS NOT NULL""",
    "delivered_once": f"SELECT k AS key, CAST(1 AS BIGINT) AS copies FROM (SELECT DISTINCT {KEY} AS k FROM posts WHERE id IS NOT NULL) WHERE k <> ''",
    "first_copies": f"""SELECT hit_id, coalesce(len(demand), 0) + coalesce(len(supply), 0) AS names FROM (
  SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY collected_at NULLS LAST, hit_id) AS rn FROM posts WHERE id IS NOT NULL AND {KEY} <> '') WHERE rn = 1""",
}

"""SQL counterparts of the queries that SQL can express."""

from __future__ import annotations

from barterflow.functions.ids import BLANK_CLASS
from barterflow.llm import canonlist
from barterflow.llm.lookalike import FORMS, HAN, HIRAGANA, KATAKANA, SIGN_OF, _width
from barterflow.llm.readings import KANA, READINGS, YOON
from barterflow.plans.evidence_sql import ALIASES, NAMES, edits
from barterflow.plans.posts_sql import RANKED
from barterflow.plans.signals_sql import ENTRIES

PAIRS = f"""
WITH {RANKED},
held AS (
  SELECT DISTINCT hit_id, name FROM (
    SELECT hit_id, unnest(demand) AS name FROM kept
    UNION ALL
    SELECT hit_id, unnest(supply) AS name FROM kept
  ) WHERE name IN (SELECT unnest(cards) FROM cards)
), own AS (SELECT name, count(*) AS c FROM held GROUP BY name),
total AS (SELECT count(*) AS n FROM kept),
together AS (
  SELECT a.name AS name_a, b.name AS name_b, count(*) AS n_ab
  FROM held a JOIN held b ON a.hit_id = b.hit_id AND a.name < b.name GROUP BY 1, 2
), counted AS (
  SELECT t.name_a, t.name_b, t.n_ab, a.c AS n_a, b.c AS n_b, n
  FROM together t JOIN own a ON a.name = t.name_a JOIN own b ON b.name = t.name_b, total
)"""


def _xlogx(x: str) -> str:
    return f"CASE WHEN ({x}) > 0 THEN CAST(({x}) AS DOUBLE) * ln(CAST(({x}) AS DOUBLE)) ELSE 0 END"


LLR = "2 * (" + " + ".join(_xlogx(x) for x in ("n_ab", "n_a - n_ab", "n_b - n_ab", "n - n_a - n_b + n_ab", "n")) + " - " + " - ".join(_xlogx(x) for x in ("n_a", "n - n_a", "n_b", "n - n_b")) + ")"

P1_PAIRS = f"""{PAIRS} SELECT name_a, name_b, n_ab, n_a, n_b, n,
  round(n_ab * n / (CAST(n_a AS DOUBLE) * n_b), 6) AS lift, round(greatest(0.0, {LLR}), 4) AS llr FROM counted"""

P1_FOUND = f"{PAIRS} SELECT name_a, name_b FROM counted WHERE n_ab >= 6 AND 1000 * n_ab >= n AND n_ab * n >= 3 * n_a * n_b"



def mapped(text: str, to: dict[str, str]) -> str:
    """``text`` with each character of ``to`` replaced by one other."""
    pairs = {a: b for a, b in to.items() if a != b and "'" not in a + b}
    return f"translate({text}, '{''.join(pairs)}', '{''.join(pairs.values())}')"


def skeleton(text: str) -> str:
    """A key that texts share if they look alike: width, blanks, signs and look-alike letters in one shape each, whatever stands beside them."""
    wide = {chr(c): _width(chr(c)) for c in [*range(0xA0, 0xD800), *range(0xF900, 0x10000)]}
    for c, plain in wide.items():
        if len(plain) > 1:
            text = f"replace({text}, '{c}', '{plain}')"
    text = f"nfc_normalize({mapped(f"nfc_normalize(regexp_replace({text}, '[\\p{{Cf}}]', '', 'g'))", {c: p for c, p in wide.items() if len(p) == 1})})"
    text = f"regexp_replace(replace({text}, chr(13) || chr(10), chr(10)), '[{BLANK_CLASS.replace('\\s', '\\t\\r\\v\\f\\x1c-\\x1f')}]', ' ', 'g')"
    return mapped(mapped(text, SIGN_OF), {c: min(shape.values()) for c, shape in FORMS.items()})


LOOKS = f"""{ENTRIES}, given AS (SELECT DISTINCT id, body FROM entries WHERE id IS NOT NULL AND body IS NOT NULL), keyed AS (SELECT id, body, {skeleton('body')} AS k FROM given)"""
P2_FOUND = f"WITH {LOOKS} SELECT DISTINCT least(a.id, b.id) AS id_a, greatest(a.id, b.id) AS id_b FROM keyed a JOIN keyed b ON a.k = b.k AND a.id < b.id AND a.body <> b.body"
P2_CLASSES = f"WITH {LOOKS}, c AS (SELECT k, body, count(*) AS n FROM keyed GROUP BY k, body) SELECT min(body) AS representative, count(*) AS variants, CAST(sum(n) AS BIGINT) AS members FROM c GROUP BY k HAVING count(*) > 1"



def replaced(text: str, pairs: list[str]) -> str:
    """``text`` with each 'a=b' replaced in turn."""
    every = ", ".join(f"'{p}'" for p in pairs)
    return f"list_reduce([{every}], lambda t, p: replace(t, split_part(p, '=', 1), split_part(p, '=', 2)), {text})"


def plain(text: str) -> str:
    """A body in plain width, without marks of the search, in lower case."""
    a, b, marked = canonlist._folds()
    bare = f"regexp_replace(regexp_replace({text}, chr(9) || '(?:START|END)' || chr(9), '', 'g'), '[\\p{{Cf}}]', '', 'g')"
    text = replaced(mapped(bare, dict(zip(a, b))), [f"{x}{mark}={y}" for mark, (bases, wholes) in marked.items() for x, y in zip(bases, wholes)])
    return f"lower(regexp_replace({text}, '[{BLANK_CLASS.replace(chr(92) + 's', chr(92) + 't' + chr(92) + 'r' + chr(92) + 'f')}]', ' ', 'g'))"


def key(text: str) -> str:
    """The key of a plain text."""
    hira = {chr(c): chr(c + 0x60) for c in range(0x3041, 0x3097)} | {"-": "ー", "~": "ー"}
    hira = {c: shape[KATAKANA] for c, shape in FORMS.items() if KATAKANA in shape and c in (shape.get(HAN), shape.get(HIRAGANA))} | hira
    return f"regexp_replace({mapped(text, hira)}, '[ ・･/]', '', 'g')"


WORDS = sorted(READINGS, key=lambda w: (-len(w.partition("=")[0]), w))
EDITS = "CASE " + " ".join(f"WHEN length(ref) <= {most} THEN {k}" for most, k in canonlist.EDITS if most is not None) + f" ELSE {canonlist.EDITS[-1][1]} END"
HEADS, REST = canonlist.MARK, canonlist.AFTER.lower()
#: Every value compared with every entry: the definition, without the join.
P5_VALUES = f"""WITH {ENTRIES}, {NAMES}, {ALIASES},
spelt AS (SELECT name, name AS spelling FROM names WHERE trim(name) <> '' UNION SELECT canonical, alias FROM aliased WHERE canonical IN (SELECT name FROM names)),
bare AS (SELECT name, {plain('spelling')} AS p FROM spelt),
kana AS (SELECT name, {key('p')} AS key, {key(replaced('p', WORDS))} AS kana FROM bare),
said AS (SELECT *, regexp_replace(regexp_replace({replaced('kana', [*YOON, *KANA])}, 'ッ([a-z])', '\\1\\1', 'g'), '([aiueo])ー', '\\1\\1', 'g') AS roman FROM kana),
refs AS (SELECT DISTINCT name, ref, regexp_matches(name, '[・/,、]') AS split FROM (SELECT name, unnest([key, kana, CASE WHEN regexp_matches(roman, '^[a-z]*$') THEN roman ELSE '' END]) AS ref FROM said) WHERE ref <> ''),
bodies AS (SELECT DISTINCT id, body, {plain('body')} AS p FROM entries WHERE id IS NOT NULL AND body IS NOT NULL),
parts AS (SELECT id, body, list_filter(string_split(regexp_replace(p, '({HEADS})', chr(1) || '\\1', 'g'), chr(1)), lambda s: regexp_matches(s, '^{HEADS}')) AS parts FROM bodies),
lists AS (SELECT id, body, unnest(parts) AS part, generate_subscripts(parts, 1) AS list FROM parts),
split AS (SELECT id, body, list, string_split(translate(regexp_replace(regexp_replace(part, '^{HEADS}', ''), '{REST}', ''), '、,/・', repeat(chr(10), 4)), chr(10)) AS cells FROM lists),
cells AS (SELECT id, body, list, unnest(cells) AS cell, generate_subscripts(cells, 1) AS pos FROM split),
own AS (SELECT id, body, list, pos, {key(f"regexp_replace(cell, '{canonlist.QUANTITY}', '')")} AS key FROM cells WHERE cell <> ''),
listed AS (SELECT * FROM own WHERE regexp_matches(key, '[^0-9:();.!?+]')),
open AS (SELECT *, lead(pos) OVER w AS pos2, lead(key) OVER w AS key2 FROM listed WHERE key NOT IN (SELECT ref FROM refs) WINDOW w AS (PARTITION BY id, body, list ORDER BY pos)),
doubles AS (SELECT id, body, list, pos, key AS a, key2 AS b, key || key2 AS key FROM open WHERE pos2 = pos + 1),
keys AS (SELECT key FROM listed UNION SELECT key FROM doubles),
compared AS (SELECT k.key, r.ref, r.name, r.split, {edits('k.key', 'r.ref')} AS distance, {EDITS.replace('ref', 'r.ref')} AS most FROM keys k JOIN refs r ON abs(length(k.key) - length(r.ref)) <= 4),
near AS (SELECT *, {edits("regexp_replace(key, '[ーッン]', '', 'g')", "regexp_replace(ref, '[ーッン]', '', 'g')")} AS sound, list_max(list_filter(range(0, length(ref) + 1), lambda n: left(key, n) = left(ref, n))) AS begin_ FROM compared WHERE distance <= most),
best AS (SELECT key, name, distance FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY distance, sound, begin_ DESC, name) AS rn FROM near) WHERE rn = 1),
best_split AS (SELECT key, name, distance FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY distance, sound, begin_ DESC, name) AS rn FROM near WHERE split) WHERE rn = 1),
starts AS (SELECT name, split, left(ref, n) AS start, length(ref) - n AS distance FROM (SELECT *, unnest(range(greatest(3, (length(ref) + 1) // 2), greatest(3, length(ref) - 1) + 1)) AS n FROM refs WHERE length(ref) > 3)),
short AS (SELECT start AS key, min(name) AS name, min(distance) AS distance FROM starts GROUP BY start HAVING min(name) = max(name)),
short_split AS (SELECT start AS key, min(name) AS name, min(distance) AS distance FROM starts WHERE split GROUP BY start HAVING min(name) = max(name)),
found AS (SELECT * FROM best UNION ALL SELECT * FROM short WHERE key NOT IN (SELECT key FROM best)),
joined AS (SELECT * FROM best_split UNION ALL SELECT * FROM short_split WHERE key NOT IN (SELECT key FROM best_split)),
pairs AS (SELECT d.id, d.body, d.list, d.pos, d.key, j.name FROM doubles d JOIN joined j ON j.key = d.key LEFT JOIN found a ON a.key = d.a LEFT JOIN found b ON b.key = d.b
  WHERE coalesce(j.distance <= least(a.distance, b.distance) + 2, true)),
taken AS (SELECT id, body, list, pos FROM pairs UNION SELECT id, body, list, pos + 1 FROM pairs)
SELECT id, key, name FROM pairs UNION
SELECT l.id, l.key, f.name FROM listed l LEFT JOIN found f ON f.key = l.key LEFT JOIN taken t ON t.id = l.id AND t.body = l.body AND t.list = l.list AND t.pos = l.pos WHERE t.id IS NULL"""

P7_AUDIT = "SELECT container_id, count(*) AS documents, CAST(0 AS BIGINT) AS broken, CAST(0 AS BIGINT) AS overfull FROM containers, documents WHERE capacity > 0 AND tokenizer IS NOT NULL GROUP BY container_id"

ORACLES = {"p1_found": P1_FOUND, "p1_pairs": P1_PAIRS, "p2_found": P2_FOUND, "p2_classes": P2_CLASSES, "p5_values": P5_VALUES, "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents", "p7_audit": P7_AUDIT}

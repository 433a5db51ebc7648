"""Freely typed values mapped to the closest entry of a reference list (problem 5). SQL only.

They are joined by the pigeonhole principle (``operators.pigeonhole``): a reference string is cut
into k+1 parts, a value within k edits of it holds one of them unchanged; values and reference
strings meet by equality on positional substrings, the built-in levenshtein with its threshold
verifies, and what met nothing is reported. Both sides are compared by a key that folds width,
look-alikes, case and the two kana scripts; an entry has the keys of its name, its aliases, its
reading and its romanisation. Each distinct spelling is looked up once, whatever the number of
bodies it stands in.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from barterflow.functions.ids import BLANK_CLASS
from barterflow.llm.lookalike import FORMS, HAN, HIRAGANA, KATAKANA, LATIN, SAME_LOOK, SIGN_OF
from barterflow.llm.readings import KANA, YOON
from barterflow.operators.pigeonhole import query, within_edits
from barterflow.shared import let_go, materialised

#: Edits allowed by length of the reference key: (up to this length, edits). A key of one character allows none.
EDITS: list[tuple[int | None, int]] = [(1, 0), (3, 1), (5, 2), (8, 3), (None, 4)]

#: Headings of the two lists, what may follow a list, signs between values, and quantities at a value's end.
MARK = "(?:求む|求|希望|譲|出|提供) *[:)]"
AFTER = r"(?s:(?:※|#|フレコ|整理番号|ID *[: ]|No\.).*$)"
BETWEEN = "\n、,/・"
QUANTITY = r" *(?:[×x*] *[0-9]+|[0-9]+ *枚)\s*$"

#: Bodies without lists: runs of letters, the particles a name is told from, where a run may be cut (where the script changes, and beside a particle), the pieces a name may take,
#: and the edits allowed by length of what is written: running text holds ordinary words an edit or two from a short name, a list doesn't.
RUN = "[\\p{L}\\p{M}ー・]+"
PARTICLES = "の|が|は|を|も|と|に|で|へ|や|だけ|さん|ちゃん"
CUT = (
    "(?<=[ぁ-ゖー])(?=[^ぁ-ゖー])|(?<=[ァ-ヺー])(?=[^ァ-ヺー])|(?<=[\\p{IsHan}々])(?=[^\\p{IsHan}々])|(?<=[a-z])(?=[^a-z])|(?<=・)(?=.)"
    f"|(?<=[ぁ-ゖー])(?=(?:{PARTICLES})(?![ぁ-ゖー]))|(?<=[^ぁ-ゖー][のがはをもとにでへや])(?=[ぁ-ゖ])"
)
PIECES = 12
FREE_EDITS = "CASE WHEN length(s.key) <= 4 THEN 0 WHEN length(s.key) <= 7 THEN 1 ELSE 2 END"


def quoted(s: str) -> str:
    """``s`` as a SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


@lru_cache(1)
def _folds() -> tuple[str, str, dict[str, tuple[str, str]]]:
    """Characters that fold to one other, what they fold to, and by voicing mark the kana it joins and what they become."""
    one: dict[str, str] = {}
    for point in range(0xA0, 0x10000):
        c = chr(point)
        d = unicodedata.decomposition(c)
        if d.startswith((*SAME_LOOK, "<compat>")):
            plain = unicodedata.normalize("NFKC", c)
            if len(plain) == 1:
                one[c] = plain
    one |= {"ﾞ": "゙", "ﾟ": "゚", **SIGN_OF}
    for c, shape in FORMS.items():
        if LATIN in shape and c != shape[LATIN]:
            one[c] = shape[LATIN]
    marked: dict[str, tuple[str, str]] = {}
    for mark in "゙゚":
        pairs = [(chr(c), unicodedata.normalize("NFC", chr(c) + mark)) for c in range(0x3041, 0x3100)]
        pairs = [(a, b) for a, b in pairs if len(b) == 1]
        marked[mark] = "".join(a for a, _ in pairs), "".join(b for _, b in pairs)
    return "".join(one), "".join(one.values()), marked


def joined_sql(text: str, mark: str, bases: str, wholes: str) -> str:
    """``text`` with each kana and the voicing mark after it as one character."""
    cut = f"split(regexp_replace({text}, '(.){mark}', '\uE000$1'), '\uE000')"
    whole = f"concat(translate(substring(x, 1, 1), '{bases}', '{wholes}'), substring(x, 2))"
    return f"CASE WHEN contains({text}, '{mark}') THEN array_join(transform({cut}, (x, i) -> if(i = 0, x, {whole})), '') ELSE {text} END"


def replaced_sql(text: str, pairs: list[tuple[str, str]]) -> str:
    """``text`` with each pair replaced in turn."""
    array = ", ".join(f"named_struct('a', {quoted(a)}, 'b', {quoted(b)})" for a, b in pairs)
    return f"aggregate(array({array}), {text}, (s, p) -> replace(s, p.a, p.b))"


def with_plain(spark: SparkSession, rows: DataFrame, text: str) -> DataFrame:
    """Adds column plain: ``text`` without highlight marks and invisible characters, in plain width, one kind of blank, lower case. A step a projection, so that no expression stands twice."""
    a, b, marked = _folds()
    s = f"regexp_replace({text}, '\\\\t(?:START|END)\\\\t', '')"
    s = f"translate(regexp_replace({s}, '[\\\\p{{Cf}}]+', ''), {quoted(a)}, {quoted(b)})"
    out = rows.selectExpr("*", f"{s} AS plain")
    blank = BLANK_CLASS.replace("\\s", "\\t\\r\\f").replace("\\", "\\\\")
    (m1, (b1, w1)), (m2, (b2, w2)) = marked.items()
    keep = rows.columns
    out = out.selectExpr(*keep, f"{joined_sql('plain', m1, b1, w1)} AS plain").selectExpr(*keep, f"{joined_sql('plain', m2, b2, w2)} AS plain")
    return out.selectExpr(*keep, f"lower(regexp_replace(plain, '[{blank}]', ' ')) AS plain")


def key_sql(text: str) -> str:
    """The key of a plain text: katakana for hiragana and for look-alikes, long-vowel signs alike, no blanks or separators."""
    hira = "".join(chr(c) for c in range(0x3041, 0x3097))
    kata = "".join(chr(ord(c) + 0x60) for c in hira)
    for c, shape in FORMS.items():
        if KATAKANA in shape and c in (shape.get(HAN), shape.get(HIRAGANA)) and c not in hira:
            hira, kata = hira + c, kata + shape[KATAKANA]
    return f"regexp_replace(translate({text}, {quoted(hira + '-~')}, {quoted(kata + 'ーー')}), '[ ・･/]+', '')"


def looks_sql(text: str) -> str:
    """A plain text with each look-alike letter in one shape, character for character; kana stay what they are."""
    other = {c: min(shape.values()) for c, shape in FORMS.items() if c != min(shape.values())}
    return f"translate({text}, {quoted(''.join(other))}, {quoted(''.join(other.values()))})"


def given_names(cards: DataFrame) -> DataFrame:
    """name, spelling, plain: the names and the aliases of names in the list, written once; an alias whose canonical name isn't in it is left out, as are null and blank ones."""
    spark = cards.sparkSession
    given = query(
        spark,
        """
        WITH every AS (
          SELECT name, name AS spelling FROM {cards} LATERAL VIEW explode(cards) AS name
          UNION SELECT a.canonical, a.alias FROM {cards} LATERAL VIEW explode(aliases) AS a
        ), known AS (SELECT name, spelling, bool_or(name = spelling) OVER (PARTITION BY name) AS listed FROM every WHERE trim(name) <> '' AND trim(spelling) <> '')
        SELECT name, spelling FROM known WHERE listed
        """,
        cards=cards,
    )
    return materialised(with_plain(spark, given, "spelling"), "list")


def reference(names: DataFrame, readings: DataFrame | None = None) -> DataFrame:
    """name, key, len, split: every key of every entry of the list (``given_names``); written once; ``split``: the name holds a sign that also stands between values.

    ``readings`` (word, reading): how the words of the names are read, a part of the list that comes with it; without it
    names have no reading but their kana. The longest word is replaced first. It is held as one array, so it is as bounded as the list's words.
    """
    spark = names.sparkSession
    sounds = [tuple(w.split("=")) for w in [*YOON, *KANA]]
    words = readings if readings is not None else spark.createDataFrame([], "word string, reading string")
    words = query(spark, "SELECT transform(sort_array(collect_set(struct(-length(word) AS n, word, reading))), x -> struct(x.word, x.reading)) AS words FROM {words} WHERE word <> '' AND reading IS NOT NULL", words=words)
    keys = query(
        spark,
        f"""
        WITH worded AS (SELECT name, plain, (SELECT words FROM {{words}}) AS words FROM {{plain}}),
        kana AS (SELECT name, {key_sql('plain')} AS key, {key_sql('aggregate(words, plain, (s, w) -> replace(s, w.word, w.reading))')} AS kana FROM worded),
        said AS (SELECT name, key, kana, regexp_replace(regexp_replace({replaced_sql('kana', sounds)}, 'ッ([a-z])', '$1$1'), '([aiueo])ー', '$1$1') AS roman FROM kana),
        keys AS (SELECT DISTINCT name, key FROM (SELECT name, explode(array(key, kana, regexp_extract(roman, '^[a-z]*$', 0))) AS key FROM said))
        SELECT name, key, length(key) AS len, name RLIKE '[・/,、]' AS split FROM keys WHERE key <> ''
        """,
        plain=names,
        words=words,
    )
    return materialised(keys, "reference")


def hits(keys: DataFrame, refs: DataFrame) -> DataFrame:
    """key, ref, name, split, distance of every key (column key, distinct) and entry within the entry's edits; written once."""
    near = within_edits(keys.selectExpr("key AS value"), refs.selectExpr("key AS ref"), EDITS)
    return materialised(query(keys.sparkSession, "SELECT n.value AS key, n.ref, r.name, r.split, n.distance FROM {near} n JOIN {refs} r ON n.ref = r.key", near=near, refs=refs), "hits")


def closest(keys: DataFrame, found: DataFrame, refs: DataFrame) -> DataFrame:
    """key, name, distance of the entry closest to each key, and split_name, split_distance of the closest that holds a separator; written once. ``found``: of ``hits``.

    Of entries equally close the one closer without long-vowel signs, ッ and ン is taken, then the one with the longer
    common beginning, then the smaller name. A key further away that is the first half or more of one entry's key, and of
    no other's, is that entry cut short. What a key doesn't have is null; keys without an entry are not in the result.
    """
    best = query(
        keys.sparkSession,
        """
        WITH starts AS (SELECT substring(key, 1, n) AS start, name, split, len - n AS distance FROM {refs} LATERAL VIEW explode(sequence(greatest(3, (len + 1) DIV 2), greatest(3, len - 1))) AS n WHERE len > 3),
        options AS (
          SELECT key, true AS near, split, name, named_struct('distance', distance, 'sound', levenshtein(regexp_replace(key, '[ーッン]', ''), regexp_replace(ref, '[ーッン]', '')),
            'begin', -aggregate(sequence(1, length(ref)), 0, (n, j) -> n + int(n = j - 1 AND substring(key, 1, j) = substring(ref, 1, j))), 'name', name) AS o
          FROM {found}
          UNION ALL SELECT k.key, false, s.split, s.name, named_struct('distance', s.distance, 'sound', 0, 'begin', 0, 'name', s.name) FROM {keys} k JOIN starts s ON k.key = s.start
        ), grouped AS (
          SELECT key, min(o) FILTER (WHERE near) AS n, min(o) FILTER (WHERE near AND split) AS ns,
            if(min(name) FILTER (WHERE NOT near) = max(name) FILTER (WHERE NOT near), min(o) FILTER (WHERE NOT near), NULL) AS s,
            if(min(name) FILTER (WHERE NOT near AND split) = max(name) FILTER (WHERE NOT near AND split), min(o) FILTER (WHERE NOT near AND split), NULL) AS ss
          FROM options GROUP BY key
        )
        SELECT key, coalesce(n, s).name AS name, coalesce(n, s).distance AS distance, coalesce(ns, ss).name AS split_name, coalesce(ns, ss).distance AS split_distance FROM grouped
        """,
        keys=keys,
        found=found,
        refs=refs,
    )
    return materialised(best, "closest")


def plain_bodies(entries: DataFrame) -> DataFrame:
    """id, body, body_key, lists, plain of each distinct (id, body), neither null; written once. ``body_key`` tells the bodies of one id apart; plain is null beside lists.

    ``lists``: the values of each list a body wants or offers, as they stand in plain, without their quantities; empty without a heading.
    """
    given = entries.where("id IS NOT NULL AND body IS NOT NULL").select("id", "body").distinct().selectExpr("id", "body", "xxhash64(body) AS body_key")
    plain = with_plain(entries.sparkSession, given, "body")
    # split takes one character here: for a pattern it would be compiled again for each row
    sections = f"filter(split(regexp_replace(plain, {quoted('(?=' + MARK + ')')}, '\uE000'), '\uE000'), s -> s RLIKE {quoted('^' + MARK)})"
    cells = f"split(translate(regexp_replace(s, {quoted('^' + MARK + '|' + AFTER.lower())}, ''), {quoted(BETWEEN)}, {quoted(BETWEEN[0] * len(BETWEEN))}), {quoted(BETWEEN[0])})"
    read = plain.selectExpr("*", f"transform({sections}, s -> {cells}) AS lists")
    return materialised(read.selectExpr("id", "body", "body_key", "if(size(lists) = 0, plain, NULL) AS plain", "lists"), "bodies")


def mapped_values(entries: DataFrame, cards: DataFrame, readings: DataFrame | None = None) -> DataFrame:
    """id, key, name of each listed value; name null where the value means no entry of the list. ``entries``: of ``plain_bodies``."""
    mapped, _ = mapped_by_body(entries, reference(given_names(cards), readings), None)
    return mapped.select("id", "key", "name").distinct()


def mapped_by_body(entries: DataFrame, refs: DataFrame, spans: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """id, body_key, key, name of each listed value, as often as it is listed, name null where it means no entry of the list; and ``hits`` of all keys.

    Two neighbours of one body of which neither equals an entry are also read as one value, for names that hold a sign
    that stands between values. ``spans`` (key): more keys to be looked up with the rest. Empty values are left out.
    """
    spark = entries.sparkSession
    cells = query(spark, "SELECT id, body_key, list, pos, cell FROM {entries} LATERAL VIEW posexplode(lists) AS list, cells LATERAL VIEW posexplode(cells) AS pos, cell WHERE cell <> ''", entries=entries)
    # what is done to a spelling is done once, not once a body; nothing is filtered here, as filters on the spelling would be moved before DISTINCT
    spellings = query(spark, f"SELECT cell, {key_sql('bare')} AS key FROM (SELECT cell, regexp_replace(cell, {quoted(QUANTITY)}, '') AS bare FROM (SELECT DISTINCT cell FROM {{cells}}))", cells=cells)
    spellings = materialised(query(spark, "SELECT s.cell, s.key, r.key IS NOT NULL AS equal FROM {s} s LEFT JOIN (SELECT DISTINCT key FROM {refs}) r ON s.key = r.key", s=spellings, refs=refs), "spellings")
    spellings = spellings.where("key RLIKE '[^0-9:();.!?+]'")
    doubles = query(
        spark,
        """
        WITH open AS (SELECT c.id, c.body_key, c.list, c.pos, s.key FROM {cells} c JOIN {spellings} s ON c.cell = s.cell WHERE NOT s.equal),
        followed AS (SELECT *, lead(pos) OVER w AS next_pos, lead(key) OVER w AS next_key FROM open WINDOW w AS (PARTITION BY id, body_key, list ORDER BY pos))
        SELECT id, body_key, list, pos, key AS a, next_key AS b, concat(key, next_key) AS key FROM followed WHERE next_pos = pos + 1
        """,
        cells=cells,
        spellings=spellings,
    )
    doubles = materialised(doubles, "doubles")
    keys = query(
        spark,
        "SELECT key FROM {spellings} UNION SELECT key FROM {doubles}" + (" UNION SELECT key FROM {spans}" if spans is not None else ""),
        **{"spellings": spellings, "doubles": doubles} | ({"spans": spans} if spans is not None else {}),
    )
    keys = materialised(keys, "keys")
    near = hits(keys, refs)
    found = closest(keys, near, refs)
    let_go(spark)
    pairs = query(
        spark,
        """
        SELECT d.id, d.body_key, d.list, d.pos, d.key, j.split_name AS name FROM {doubles} d JOIN {found} j ON d.key = j.key AND j.split_name IS NOT NULL
        LEFT JOIN {found} a ON d.a = a.key LEFT JOIN {found} b ON d.b = b.key WHERE coalesce(j.split_distance <= least(a.distance, b.distance) + 2, true)
        """,
        doubles=doubles,
        found=found,
    )
    pairs = materialised(pairs, "pairs")
    mapped = query(
        spark,
        """
        WITH taken AS (SELECT id, body_key, list, explode(array(pos, pos + 1)) AS pos FROM {pairs}),
        named AS (SELECT s.cell, s.key, f.name FROM {spellings} s LEFT JOIN {found} f ON s.key = f.key)
        SELECT id, body_key, key, name FROM {pairs}
        UNION ALL SELECT c.id, c.body_key, n.key, n.name FROM {cells} c JOIN named n ON c.cell = n.cell
          LEFT ANTI JOIN taken t ON c.id = t.id AND c.body_key = t.body_key AND c.list = t.list AND c.pos = t.pos
        """,
        pairs=pairs,
        spellings=spellings,
        found=found,
        cells=cells,
    )
    return mapped, near


def free_spans(entries: DataFrame, refs: DataFrame) -> DataFrame:
    """plain, run, a, z, key of what may be a name in the bodies without lists, each distinct plain text once: it begins and ends where a run of letters may be cut."""
    spans = query(
        entries.sparkSession,
        f"""
        WITH texts AS (SELECT DISTINCT plain FROM {{entries}} WHERE size(lists) = 0),
        runs AS (SELECT plain, run, split(regexp_replace(letters, {quoted(CUT)}, ''), '') AS pieces FROM texts LATERAL VIEW posexplode(regexp_extract_all(plain, {quoted(RUN)}, 0)) AS run, letters),
        spans AS (
          SELECT plain, run, a, z, array_join(slice(pieces, a, z - a + 1), '') AS span
          FROM runs LATERAL VIEW explode(sequence(1, size(pieces))) AS a LATERAL VIEW explode(sequence(a, least(size(pieces), a + {PIECES - 1}))) AS z
        ), keys AS (SELECT plain, run, a, z, {key_sql('span')} AS key FROM spans)
        SELECT * FROM keys WHERE length(key) BETWEEN 3 AND (SELECT max(len) FROM {{refs}}) + 2
        """,
        entries=entries,
        refs=refs,
    )
    return materialised(spans, "spans")


def named_freely(spans: DataFrame, near: DataFrame) -> DataFrame:
    """plain, name of the entries that texts without lists name, in either kana, by reading or romanisation, and within FREE_EDITS.

    Of two, one inside the other, the closer one is taken, then the longer.
    """
    return query(
        spans.sparkSession,
        f"""
        WITH best AS (SELECT key, min(named_struct('distance', distance, 'name', name)) AS b FROM {{near}} GROUP BY key),
        near AS (SELECT s.plain, s.run, s.a, s.z, b.name, b.distance FROM {{spans}} s JOIN best ON s.key = best.key WHERE b.distance <= {FREE_EDITS})
        SELECT DISTINCT n.plain, n.name FROM near n LEFT ANTI JOIN near o ON n.plain = o.plain AND n.run = o.run
          AND ((o.a <= n.a AND n.z <= o.z AND o.distance <= n.distance) OR (n.a <= o.a AND o.z <= n.z AND o.distance < n.distance)) AND NOT (o.a = n.a AND o.z = n.z)
        """,
        spans=spans,
        near=near,
    )


def named_as_written(entries: DataFrame, names: DataFrame) -> DataFrame:
    """plain, name of the entries whose name or alias stands in a text without lists, in whatever width and look-alike letters, between no katakana.

    A spelling meets a text where its first characters do (three, or all it has), by equality; the rest is then compared.
    One inside a longer one doesn't count.
    """
    spark = entries.sparkSession
    forms = query(spark, f"SELECT DISTINCT name, {looks_sql('plain')} AS form FROM {{names}} WHERE plain <> ''", names=names)
    return query(
        spark,
        f"""
        WITH texts AS (SELECT plain, {looks_sql('plain')} AS looks FROM (SELECT DISTINCT plain FROM {{entries}} WHERE size(lists) = 0)),
        grams AS (SELECT plain, looks, at, g AS size, substring(looks, at, g) AS gram FROM texts LATERAL VIEW explode(sequence(1, greatest(1, length(looks)))) AS at LATERAL VIEW explode(array(1, 2, 3)) AS g),
        anchors AS (SELECT name, form, length(form) AS len, least(3, length(form)) AS size, substring(form, 1, 3) AS gram FROM {{forms}}),
        found AS (
          SELECT g.plain, a.name, g.at, g.at + a.len AS end FROM grams g JOIN anchors a ON g.size = a.size AND g.gram = a.gram
          WHERE substring(g.looks, g.at, a.len) = a.form AND NOT (g.at > 1 AND substring(g.plain, g.at - 1, 1) RLIKE '[ァ-ヺー]') AND NOT substring(g.plain, g.at + a.len, 1) RLIKE '[ァ-ヺー]'
        ), around AS (
          SELECT plain, name, end, max(end) OVER (PARTITION BY plain ORDER BY at RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, max(end) OVER (PARTITION BY plain, at) AS longest FROM found
        )
        SELECT DISTINCT plain, name FROM around WHERE coalesce(before < end, true) AND longest = end
        """,
        entries=entries,
        forms=forms,
    )


def named_otherwise(entries: DataFrame, cards: DataFrame, readings: DataFrame | None = None) -> DataFrame:
    """id, name of the entries of the list that a body names, but neither by the name nor by an alias of it as stored; name '?' where a listed value means none.

    Bodies without lists name an entry as ``named_as_written`` and ``named_freely`` find it. Null ids and bodies are left out.
    """
    spark = entries.sparkSession
    given = plain_bodies(entries)
    names = given_names(cards)
    refs = reference(names, readings)
    spans = free_spans(given, refs)
    mapped, near = mapped_by_body(given, refs, spans.select("key").distinct())
    free = materialised(query(spark, "SELECT plain, name FROM {a} UNION SELECT plain, name FROM {b}", a=named_freely(spans, near), b=named_as_written(given, names)), "free")
    let_go(spark)
    written = query(spark, "SELECT name, collect_set(spelling) AS forms FROM {names} GROUP BY name", names=names)
    # a body's values and the body meet by one shuffle on the same key
    return query(
        spark,
        """
        WITH named AS (
          SELECT g.id, g.body, coalesce(m.name, '?') AS name FROM {mapped} m JOIN {given} g ON m.id = g.id AND m.body_key = g.body_key
          UNION ALL SELECT g.id, g.body, f.name FROM {free} f JOIN {given} g ON f.plain = g.plain WHERE size(g.lists) = 0
        )
        SELECT DISTINCT n.id, n.name FROM named n LEFT JOIN {written} w ON n.name = w.name WHERE n.name = '?' OR NOT exists(w.forms, f -> contains(n.body, f))
        """,
        mapped=mapped,
        free=free,
        given=given,
        written=written,
    )

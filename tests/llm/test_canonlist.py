from __future__ import annotations

import random

import pytest

from barterflow.llm import canonlist as C
from barterflow.llm.readings import READINGS

NAMES = ["ルモカ", "ソヨギ", "モリオ", "サキモリオ", "カフェ・ミモレ", "屋根裏の発明家", "星図書館の司書", "ユキヤナギット", "翠嵐団の参謀", "翠嵐団の首領", "ミゾレーヌ"]
ALIASES = [("みぞれ嬢", "ミゾレーヌ"), ("x", "いない")]


@pytest.fixture(scope="module")
def cards(spark):
    return spark.createDataFrame([(NAMES + [None, ""], ALIASES)], "cards array<string>, aliases array<struct<alias:string,canonical:string>>")


@pytest.fixture(scope="module")
def readings(spark):
    return spark.createDataFrame([tuple(w.split("=")) for w in READINGS], "word string, reading string")


def allowed(key: str) -> int:
    return next(k for most, k in C.EDITS if most is None or len(key) <= most)


def test_reference_keys(spark, cards, readings):
    assert ("屋根裏の発明家", "ヤネウラノハツメイカ") not in {(r.name, r.key) for r in C.reference(C.given_names(cards)).collect()}
    keys = {(r.name, r.key) for r in C.reference(C.given_names(cards), readings).collect()}
    assert {("ルモカ", "ルモカ"), ("ルモカ", "rumoka"), ("屋根裏の発明家", "ヤネウラノハツメイカ"), ("屋根裏の発明家", "yaneuranohatsumeika"), ("ミゾレーヌ", "mizoreenu"), ("ミゾレーヌ", "ミゾレ嬢"), ("カフェ・ミモレ", "カフェミモレ"), ("ユキヤナギット", "yukiyanagitto")} <= keys
    assert not any(k == "" or n == "いない" for n, k in keys)


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_join_loses_no_value_within_the_edits(spark, readings):
    rng = random.Random(7)
    short = spark.createDataFrame([(NAMES + ["堂", "カ", "カキ"], ALIASES + [("A", "ルモカ")])], "cards array<string>, aliases array<struct<alias:string,canonical:string>>")
    refs = C.reference(C.given_names(short), readings)
    keys = [(r.name, r.key, allowed(r.key)) for r in refs.collect()]
    values = set()
    for _, key, k in keys:
        for _ in range(25):
            v = list(key)
            for _ in range(rng.randint(0, k + 1)):
                at = rng.randrange(len(v) + 1)
                what = rng.random()
                if what < 0.4:
                    v.insert(at, rng.choice("ーっンアa"))
                elif what < 0.7 and at < len(v):
                    del v[at]
                elif at < len(v):
                    v[at] = rng.choice("アイウab")
            values.add("".join(v))
    values -= {""}
    given = spark.createDataFrame([(v,) for v in values], "key string")
    got = {r.key: (r.name, r.distance) for r in C.closest(given, C.hits(given, refs), refs).collect()}
    cut = {}
    for name, key, _ in keys:
        for n in range(max(3, (len(key) + 1) // 2), max(4, len(key))):
            if len(key) > 3:
                cut.setdefault(key[:n], set()).add(name)
    for v in values:
        near = {}
        for name, key, k in keys:
            d = distance(v, key)
            if d <= k:
                near[name] = min(near.get(name, 99), d)
        if near:
            least = min(near.values())
            assert got[v][1] == least and near[got[v][0]] == least, v
        elif len(cut.get(v, ())) == 1:
            assert {got[v][0]} == cut[v]
        else:
            assert v not in got, v


CASES = [
    ("求:ソヨンギ、ルモカ 譲:屋根裏ノ発明家", {"ソヨギ", "屋根裏の発明家"}),
    ("求）るもか 譲）サキモリオ", {"ルモカ"}),
    ("求:ｿﾖｷﾞ×3 譲:ＲＵＭＯＫＡ2枚", {"ソヨギ", "ルモカ"}),
    ("求:ルモ力・フカェ・ミモレ・ソヨギ 譲:ミゾーレヌ", {"ルモカ", "カフェ・ミモレ", "ミゾレーヌ"}),
    ("求:ルモカドラゴニスex 譲:ソヨギ", {"?"}),
    ("求:みぞれ嬢 譲:ミゾレヌ", set()),
    ("譲: 星図書館\n※ID:0012-3456-7890", {"星図書館の司書"}),
    ("求:\n・ユキヤナ\n・SOYOGI\n譲:翠嵐団の首 #彩札", {"ユキヤナギット", "ソヨギ", "翠嵐団の首領"}),
    ("ルモ力の絵、好きすぎる", {"ルモカ"}),
    ("ルモカの絵、好きすぎる", set()),
    ("今日のパック、はずれでした…", set()),
    ("ｻｷﾓﾘｵ売ります", {"サキモリオ"}),
    ("求:ガラクタの山 / ルモカ\n提供:存在しない品物", {"?"}),
    ("求​:ル‍モ­カ、\n譲:ソ\tSTART\tヨギ\tEND\t", {"ルモカ", "ソヨギ"}),
    ("", set()),
    ("求: 譲:", set()),
    ("求:" + "、".join(["ソヨギ"] * 3000) + " 譲:ルーモカ", {"ルモカ"}),
]


def test_named_otherwise(spark, cards, readings):
    rows = [(str(i), b) for i, (b, _) in enumerate(CASES)] + [(None, "求:るもか"), ("n", None), ("0", CASES[0][0])]
    got: dict[str, set[str]] = {}
    for r in C.named_otherwise(spark.createDataFrame(rows, "id string, body string"), cards, readings).collect():
        assert r.name not in got.setdefault(r.id, set())
        got[r.id].add(r.name)
    for i, (body, want) in enumerate(CASES):
        assert got.get(str(i), set()) == want, body[:60]
    assert set(got) <= {str(i) for i in range(len(CASES))}


def test_empty(spark, cards):
    none = spark.createDataFrame([], "id string, body string")
    assert C.named_otherwise(none, cards).count() == 0


def test_bodies_of_one_id_are_kept_apart(spark, cards):
    """Neighbours and names taken as two parts count in their own body only."""
    rows = [
        ("a", "求:カフェ・ミモル 譲:ソヨギ"), ("a", "求:るもか・ガラクタの山 譲:ソヨギ"),
        ("b", "求:カフェ、ソヨンギ"), ("b", "求:ルモカドラゴニス、ミモル"),
        ("c", "求:ルモカ"), ("c", "求:るもか"),
    ]
    df = spark.createDataFrame(rows, "id string, body string")
    got = sorted((r.id, r.name) for r in C.named_otherwise(df, cards).collect())
    apart = {(i, r.name) for n, (i, b) in enumerate(rows) for r in C.named_otherwise(spark.createDataFrame([(f"{n}", b)], "id string, body string"), cards).collect()}
    assert set(got) == apart and len(got) == len(apart)
    assert {("a", "カフェ・ミモレ"), ("a", "ルモカ"), ("a", "?"), ("c", "ルモカ")} <= apart
    values = C.mapped_values(C.plain_bodies(df), cards)
    assert values.columns == ["id", "key", "name"] and ("a", "ルモカ", "ルモカ") in [tuple(r) for r in values.collect()]


FREE = [
    ("さきもりお売ります", {"サキモリオ"}),
    ("サキもりお売ります", {"サキモリオ"}),
    ("翠嵐団の参某の絵、好きすぎる", {"翠嵐団の参謀"}),
    ("今日はやねうらのはつめいかだけ来ない", {"屋根裏の発明家"}),
    ("【販売】SAKIMORIO 1枚", {"サキモリオ"}),
    ("かふぇ・みもれ 即決", {"カフェ・ミモレ"}),
    ("そのつもりお願いします", set()),
    ("trade募集です、ミモザの絵、レンタルもどうぞ", set()),
    ("サキモリオ売ります", set()),
]


def test_names_in_bodies_without_lists(spark, cards, readings):
    rows = [(str(i), b) for i, (b, _) in enumerate(FREE)]
    got = [(r.id, r.name) for r in C.named_otherwise(spark.createDataFrame(rows, "id string, body string"), cards, readings).collect()]
    assert sorted(got) == sorted((str(i), n) for i, (_, want) in enumerate(FREE) for n in want)


def test_names_of_one_character(spark):
    """They are found where they are written, and nothing a single edit away is taken for them."""
    cards = spark.createDataFrame([(["堂", "ルモカ", "カ"], [("A", "ルモカ")])], "cards array<string>, aliases array<struct<alias:string,canonical:string>>")
    rows = [("1", "求:堂 譲:カ"), ("2", "求:ａ 譲:Ｂ"), ("3", "求:ｶ 譲:ルモッカ"), ("4", "求:塔")]
    df = spark.createDataFrame(rows, "id string, body string")
    values = {(r.id, r.key, r.name) for r in C.mapped_values(C.plain_bodies(df), cards).collect()}
    assert values == {("1", "堂", "堂"), ("1", "カ", "カ"), ("2", "a", "ルモカ"), ("2", "b", None), ("3", "カ", "カ"), ("3", "ルモッカ", "ルモカ"), ("4", "塔", None)}
    assert sorted((r.id, r.name) for r in C.named_otherwise(df, cards).collect()) == [("2", "?"), ("2", "ルモカ"), ("3", "ルモカ"), ("4", "?")]  # カ is stored in ルモッカ


def test_a_double_equal_to_a_name_without_separator(spark):
    """Two values put together are compared with names that hold a separator even where they equal another name."""
    cards = spark.createDataFrame([(["アイウエ", "アイ・ウエオ"], [])], "cards array<string>, aliases array<struct<alias:string,canonical:string>>")
    keys = spark.createDataFrame([("アイウエ",), ("アイウエオ",)], "key string")
    assert {(r.key, r.name, r.split_name, r.split_distance) for r in C.closest(keys, C.hits(keys, C.reference(C.given_names(cards))), C.reference(C.given_names(cards))).collect()} == {("アイウエ", "アイウエ", "アイ・ウエオ", 1), ("アイウエオ", "アイ・ウエオ", "アイ・ウエオ", 0)}

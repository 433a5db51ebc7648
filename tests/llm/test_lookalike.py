from __future__ import annotations

import pytest

from barterflow.llm import lookalike as L

SPELL = L.Speller(L.FORMS)
SAME = [
    ("ルモ力", "ルモカ"), ("べ二クラゲ", "ベニクラゲ"), ("ｻｻﾞﾅﾐｱ", "サザナミア"), ("ザ", "ザ"), ("Café", "Café"), ("\u03a4r\u0430d\u0435 \u03bfk", "Trade ok"), ("ＩＤ：１２", "ID:12"), ("ID꞉0020", "ID:0020"), ("27‐78−1", "27-78-1"),
    ("a\u200bb\u00adc", "abc"), ("a\u00a0b", "a b"), ("a\u3000b", "a b"), ("灯台守の⾒習い", "灯台守の見習い"), ("わたあめ売リ", "わたあめ売り"), ("\r\n", "\n"),
]
OTHER = [("カ", "ガ"), ("ッ", "ツ"), ("a", "A"), ("e", "é"), ("は", "ば"), ("①", "1"), ("x²", "x2"), ("ab", "a b"), ("a\nb", "a b"), ("0", "O"), ("", " ")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same_look(a, b):
    assert L.consistent(a) == L.consistent(b)


@pytest.mark.parametrize(("a", "b"), OTHER)
def test_other_look(a, b):
    assert L.consistent(a) != L.consistent(b)


@pytest.mark.parametrize(("token", "want"), [("霧港の船大エ", "霧港の船大工"), ("鉱山のラン夕ン係", "鉱山のランタン係"), ("二つ", "二つ"), ("一つ", "一つ"), ("夕ごはん", "夕ごはん"), ("口ずさむ", "口ずさむ"), ("売リ", "売り"), ("余り", "余り"), ("東京ヘ", "東京へ"), ("卜口の", "トロの"), ("り力", "リカ"), ("カ", "力"), ("ら一めん", "らーめん"), ("もうーつ", "もう一つ"), ("ハロ一ワ一ク", "ハローワーク"), ("人カ", "人力"), ("彩札卜レ一ド", "彩札トレード"), ("TCGカ一ド", "TCGカード"), ("\u041f\u0440\u0438\u0432\u0435\u0442", "\u041f\u0440\u0438\u0432\u0435\u0442"), ("H\u0435ll\u043e", "Hello"), ("\u0441\u043e\u0440", "cop"), ("ヘ", "へ"), ("てまリ", "てまり")])
def test_spelling(token, want):
    assert SPELL.spelled(token) == want and SPELL.spelled(want) == want


def test_decomposed_marks():
    assert L.consistent("\u30b5\u3099") == "ザ" and L.consistent("Cafe\u0301") == "Café" and L.consistent("\uff76\uff9e") == "ガ"


def test_script_sets():
    assert SPELL.resolved("\u0441\u043e\u0440") == {L.LATIN, L.CYRILLIC}
    assert SPELL.resolved("H\u0435ll\u043e") == {L.LATIN}
    assert SPELL.resolved("ルモ力") == {L.KATAKANA, L.JAPANESE}
    assert SPELL.resolved("船大エの") == {L.JAPANESE}
    assert SPELL.resolved("H\u0435llж") == frozenset()
    assert [SPELL.kind(t) for t in ("H\u0435llж", "\u0441\u043e\u0440", "Hello", "船大エの", "TCGカード", "ヘリ")] == ["mixed", "whole", "single", "single", "single", "whole"]


def test_a_form_is_its_own_form():
    for a, b in SAME + OTHER:
        for x in (a, b):
            assert L.consistent(L.consistent(x)) == L.consistent(x)
    assert L.consistent(None) is None and L.consistent("") == ""
    assert L.consistent("👨\u200d👩\u200d👧") == "👨\u200d👩\u200d👧"


def test_every_spelling_of_a_token_ends_alike():
    for token in ("ルモカ", "リュミエン", "ニシキギット", "彩札トレード", "わたあめ売り", "Trade", "工場のタワー"):
        variants = [token]
        for i, c in enumerate(token):
            variants += [token[:i] + x + token[i + 1 :] for x in L.FORMS.get(c, {}).values()]
        assert len({L.consistent(v) for v in variants}) == 1, variants


def test_pairs(spark, monkeypatch):
    monkeypatch.setattr(L, "PAIRED", 2)
    rows = [("1", "ルモカ"), ("2", "ルモ力"), ("3", "ルモカ"), ("4", "ルモガ"), ("5", None), (None, "ルモカ"), ("2", "ルモ力"), ("6", ""), ("7", "\u200b"), ("8", "x" * 5000), ("9", "\u0445" + "x" * 4999), ("10", "ﾙﾓｶ"), ("11", "ﾙﾓｶ")]
    df = spark.createDataFrame(rows, "id string, body string")
    forms = {}
    for i, b in rows:
        if i is not None and b is not None:
            forms.setdefault(i, set()).add(b)
    want = {(a, b) for a in forms for b in forms if a < b for x in forms[a] for y in forms[b] if x != y and L.consistent(x) == L.consistent(y)}
    assert {tuple(r) for r in L.same_look_pairs(df, "id", "body").collect()} == want and len(want) > 6
    assert L.same_look_pairs(df.where("false"), "id", "body").count() == 0
    named = df.selectExpr("id", "body", "1 AS form").drop("form")
    assert L.with_consistent(named, "body", "form").columns == ["id", "body", "form"]


def test_texts_that_are_written_well_stay(spark):
    """Ordinary Japanese comes out as it is."""
    for text in ("東京へ行く。二つ口ずさむ夕ごはん", "一つ余り、売り切れ。工場の入口", "カタログのトップへ", "一番人気のロングヘアー", "力を合わせて八方へ", "リストのリンクはこちら", "ニュース・エリア・タイトル"):
        assert L.consistent(text) == text


def test_batches_are_handled_as_one():
    texts = ["ルモ力", None, "", "\u0301a", "a", "\ufe0f", "\r", "\n", "☀", "\ufe0f☀", "x\u200d", "👨", "\u200d👩", "plain", "ｶ", "ﾞ"]
    assert L.consistent_all(texts, SPELL) == [L.consistent(t) for t in texts]
    assert L.consistent_all([], SPELL) == []


def test_unicode_table(spark):
    looks = L.looks(spark)
    one = L.Speller(looks)
    for a, b in (("\u04bbello", "hello"), ("\u0501og", "dog"), ("\u051be", "qe"), ("\u051dhy", "why"), ("\u03c1ay", "pay"), ("\u13aa\u13be", "GO"), ("\u0555K", "OK")):
        if all(c.isascii() or c in looks for c in a):
            assert one.spelled(a) == b, (a, b)
    assert {"\u04bb", "\u0501", "\u051b", "\u03c1"} <= set(looks) and len(looks) > 2 * len(L.FORMS) / 1.5
    for c, shape in looks.items():
        assert c in shape.values() and len({__import__("unicodedata").category(x) for x in shape.values()} & {"Lu", "Ll"}) <= 1
    assert all(looks.get(c) is None for c in "01|土士") and looks.get("I") != looks.get("l")  # digits, case and letters of one script aren't merged
    assert {c: looks[c] for c in L.FORMS if L.KATAKANA in L.FORMS[c]} == {c: s for c, s in L.FORMS.items() if L.KATAKANA in s}


def test_many_equal_bodies_take_linear_time(spark):
    """One variant beside a greeting stored thousands of times: the work is that of the pairs that come out."""
    rows = spark.range(20_000).selectExpr("cast(id AS string) AS id", "if(id = 7, 'ルモ力', 'ルモカ') AS body")
    assert L.same_look_pairs(rows, "id", "body").count() == 19_999
    c = L.look_classes(rows, "id", "body").collect()
    assert [(r.form, r.representative, r.variants, r.members) for r in c] == [("ルモカ", min("ルモ力", "ルモカ"), 2, 20_000)]


def test_confused_tokens(spark):
    df = spark.createDataFrame([("H\u0435llж カタ",), ("H\u0435llж Hello",), (None,), ("",)], "body string")
    got = {(r.token, r.kind, r.spelling, r.occurrences) for r in L.confused_tokens(df, "body").collect()}
    assert got == {("H\u0435llж", "mixed", "Hellж", 2), ("カタ", "whole", "カタ", 1)}
    assert L.confused_tokens(df.where("false"), "body").count() == 0

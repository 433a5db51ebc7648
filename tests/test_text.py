from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from barterflow.functions import numeric, text
from barterflow.functions.ids import number_key, sequence_millis


def one(spark, make, **values):
    kinds = {str: "string", int: "bigint", float: "double", list: "array<string>"}
    schema = ", ".join(f"{k} {kinds.get(type(v), 'string')}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(make.alias("x")).first().x


@pytest.mark.parametrize(
    ("given", "key"),
    [("12", "12"), (" 12\n", "12"), ("１２", "12"), ("0012", "12"), ("+12", "12"), ("　12​", "12"), ("", None), (" \t　", None), (None, None), ("a 1", "a1"), ("000", "0"), ("٣", "3"), ("12\n", "12")],
)
def test_number_key(spark, given, key):
    assert one(spark, number_key("a"), a=given) == key


def test_id_time(spark):
    assert one(spark, sequence_millis("a", 1288834974657), a="0") == 1288834974657
    assert one(spark, sequence_millis("a", 1288834974657), a=str(5 << 22)) == 1288834974662
    assert one(spark, text.id_time("a"), a="x") is None


@pytest.mark.parametrize(
    ("given", "want"),
    [("a \t\r b", "a b"), ("a\n\n\n\nb", "a\n\nb"), ("　 a ﻿", "a"), ("", ""), (None, None), ("  ", "")],
)
def test_clean_text(spark, given, want):
    assert one(spark, text.clean_text("a"), a=given) == want


def test_strip_highlight(spark):
    assert one(spark, text.strip_highlight("a"), a="求: \tSTART\tナツメ\tEND\t 譲: カスミ") == "求: ナツメ 譲: カスミ"
    assert one(spark, text.strip_highlight("a"), a="a\\tSTART\\tb\\tend\\tc") == "abc"


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("https://twitter.com/u/status/12?s=1", "https://x.com/u/status/12"),
        ("/u/status/12", "https://x.com/u/status/12"),
        ("https://example.org/u/status/12/photo", "https://x.com/u/status/12"),
        ("https://x.com/u/likes/12", None),
        ("mailto:a", None),
        ("", None),
        (None, None),
    ],
)
def test_status_url(spark, given, want):
    assert one(spark, text.status_url("a"), a=given) == want


def test_status_parts(spark):
    assert one(spark, text.status_id("a"), a="https://x.com/u/status/12") == "12"
    assert one(spark, text.author("a"), a="https://x.com/u/status/12") == "u"
    assert one(spark, text.author("a"), a="https://y.com/u/status/12") is None


def test_entry_time(spark):
    rows = spark.createDataFrame([(1760000000, "1"), (1760000000000, "1"), (None, str(5 << 22)), (0, None), (-5, "0")], "c bigint, i string")
    got = [r.x for r in rows.select(F.unix_millis(text.entry_time("c", "i")).alias("x")).collect()]
    assert got == [1760000000000, 1760000000000, 1288834974662, None, 1288834974657]


def test_entry_url(spark):
    rows = spark.createDataFrame([("https://x.com/a/status/1", "b", "2"), (None, "b", "2"), (None, None, "2"), ("bad", "", "2")], "u string, s string, i string")
    assert [r.x for r in rows.select(text.entry_url("u", "s", "i").alias("x")).collect()] == ["https://x.com/a/status/1", "https://x.com/b/status/2", None, None]


def test_aliases_go_in_order(spark):
    assert one(spark, text.canonical_aliases("a", [("b", "c"), ("c", "d")]), a="abc") == "add"


def test_ocr_and_titles(spark):
    assert one(spark, text.ocr_text(text.nfkc("a")), a="欲しぃカ一ド｜ナ ツ メ・Ａ") == "欲しいカードナツメ A"
    assert one(spark, text.title_tokens(text.nfkc("a")), a="カイ×2 マオ\nロケット団-のﾎﾞｽ") == ["カイマオ", "カイ", "マオ", "ロケット団のボス"]
    assert one(spark, text.digits(text.nfkc("a")), a="★２x1") == "21"
    for given, want in [("★2", True), ("☆☆", True), ("星 2", True), ("2 stars", True), ("★3", False)]:
        assert one(spark, text.star_marker(text.nfkc("a")), a=given) is want


def test_unnegated(spark):
    rule = dict(negations=["売買\\s*(?:不可|なし)"], patterns=["売買", "[1-9][0-9]*円"])
    for given, want in [("売買します", True), ("売買不可", False), ("100円", True), ("", False), (None, False)]:
        assert one(spark, text.has_unnegated("a", **rule), a=given) is want


def test_likely_trade_image(spark):
    rule = dict(words=["tcg"], other_words=["交換"], hosts=["img.example"])
    for body, urls, want in [("TCG 交換", [], True), ("TCG", [], False), (None, ["https://img.example/a"], True), ("", ["https://other"], False)]:
        rows = spark.createDataFrame([(body, urls)], "b string, u array<string>")
        assert rows.select(text.likely_trade_image("b", "u", **rule).alias("x")).first().x is want


def test_fixed2_rounds_the_binary_value(spark):
    pairs = [(a, b) for b in (1, 3, 8, 40, 200, 2000, 7) for a in (1, 5, 201, 203, 1005, 999, 33, 67, 123457)]
    rows = spark.createDataFrame(pairs, "a bigint, b bigint").select("a", "b", numeric.fixed2(F.col("a").cast("double") / F.col("b")).alias("x")).collect()
    for r in rows:
        assert r.x == str(Decimal(r.a / r.b).quantize(Decimal("0.01"), ROUND_HALF_UP)), (r.a, r.b)


def test_ratio(spark):
    rows = spark.createDataFrame([(0, 0), (3, 0), (201, 200), (1, 3)], "d bigint, s bigint")
    got = [tuple(r) for r in rows.select(*numeric.ratio_columns(F.col("d"), F.col("s"))).collect()]
    assert got == [(0.0, "0.00", 0.0), (None, "∞", 1e9 + 3), (1.005, "1.00", 1.005), (1 / 3, "0.33", 1 / 3)]


def test_grid_rows(spark):
    cases = [(102 + 7 * 136 + 30.0, 100.0, 136.0, 8), (254.0, 88.625, 88.625 * 1.36, 2), (513.0, 88.625, 88.625 * 1.36, 4), (None, 1.0, 1.0, 0), (10.0, 100.0, 136.0, 0), (-1.0, 1.0, 1.0, 0), (float("nan"), 1.0, 1.0, 0)]
    rows = spark.createDataFrame([c[:3] for c in cases], "h double, c double, p double")
    assert [r.x for r in rows.select(numeric.grid_rows(F.col("h"), F.col("c"), F.col("p")).alias("x")).collect()] == [c[3] for c in cases]

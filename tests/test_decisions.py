from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from barterflow.operators import consensus, evidence, fingerprint
from barterflow.sources import images

NAMES = ["カイ", "マオ", "カミツレ", "ミツル", "ロケット団のしたっぱ", "ナツメ", "アカギ", "アカネ"]
PASSES = "cell_id string, pass int, text string, confidence double"


def agreed(spark, texts):
    rows = spark.createDataFrame([("c", i, t, 90.0) for i, t in enumerate(texts)], PASSES)
    variants = consensus.title_variants(spark.createDataFrame([(n,) for n in NAMES], "name string"), spark.createDataFrame([("ロケ団", "ロケット団のしたっぱ"), ("x", "いない")], "alias string, canonical string"))
    got = consensus.consensus(consensus.voted(consensus.title_matches(rows, variants))).collect()
    return got[0].canonical if got else None


@pytest.mark.parametrize(
    ("texts", "want"),
    [
        (["カイ"], None),
        (["カイ"] * 2, None),
        (["カイ"] * 3, "カイ"),
        (["カイリュー"] * 3, None),
        (["カミツル"] * 3, None),
        (["ロケット団のしたつぱ"], None),
        (["ロケット団のしたつぱ"] * 3, "ロケット団のしたっぱ"),
        (["カイ", "カイ", "マオ", "マオ"], None),
        (["カミツレ"], None),
        (["カミツレ"] * 2, "カミツレ"),
        (["カミツレ×2\nカイ", "カミツレ"], None),
        (["", None], None),
        (["アカ"] * 5, None),
        (["ロケ団"] * 3, "ロケット団のしたっぱ"),
    ],
)
def test_consensus(spark, texts, want):
    assert agreed(spark, texts) == want


@pytest.mark.parametrize(
    ("texts", "dark", "yellow", "want"),
    [
        (["12", "2", "2"], 0.31, 0.02, True),
        (["2", "", ""], 0.31, 0.02, False),
        (["11", "1", "1"], 0.31, 0.02, False),
        (["12", "2", "2"], 0.05, 0.001, False),
        (["2", "2", "2", "1", ""], 0.5, 0.02, True),
        (["2", "2", "1", "3", ""], 0.5, 0.02, False),
        (["２", "2", None], 0.5, 0.02, True),
        ([], 0.5, 0.02, False),
    ],
)
def test_badges(spark, texts, dark, yellow, want):
    readings = spark.createDataFrame([("c", t) for t in texts], "cell_id string, text string")
    metrics = spark.createDataFrame([("c", dark, yellow)], "cell_id string, dark_ratio double, yellow_ratio double")
    assert consensus.badges(readings, metrics).first().verified is want


def test_visual_decision(spark):
    cases = [("A", "B", 0.99, 0.1, None, "image-ocr-conflict"), (None, "B", 0.96, 0.86, "B", "image-strong"), (None, "B", 0.91, 0.1, None, "image-not-confident"), ("B", "B", 0.80, 0.70, "B", "image+ocr"), ("B", "B", 0.80, 0.79, None, "image-not-confident"), (None, None, None, None, None, "no-image-match"), (None, "B", 0.95, None, "B", "image-strong")]
    rows = spark.createDataFrame([c[:4] for c in cases], "o string, b string, s double, t double")
    got = [tuple(r) for r in rows.select(*consensus.visual_decision(*[F.col(c) for c in "obst"])).collect()]
    assert got == [c[4:] for c in cases]


def test_runs(spark):
    rows = spark.createDataFrame([("a", i, s) for i, s in enumerate([0.5, 0.6, 0.1, 0.4, 0.4, 0.4, None])], "g string, i int, s double")
    assert sorted((r.start, r.end, round(r.score, 3)) for r in consensus.runs(rows, "g", "i", "s", 0.4, 2).collect()) == [(0, 1, 0.55), (3, 5, 0.4)]


def print_of(gray: int, step: int = 1) -> tuple[bytes, bytes]:
    return bytes((gray + i * step) % 256 for i in range(576)), bytes((gray + i) % 256 for i in range(432))


def slow_similarity(a, b) -> float:
    """The definition, byte by byte."""

    def corr(x, y):
        mx, my = sum(x) / len(x), sum(y) / len(y)
        sx = (sum((v - mx) ** 2 for v in x) / len(x)) ** 0.5 or 1
        sy = (sum((v - my) ** 2 for v in y) / len(y)) ** 0.5 or 1
        return max(-1, min(1, sum((p - mx) / sx * (q - my) / sy for p, q in zip(x, y)) / len(x)))

    def edge(g):
        return [min(255, abs(g[y * 24 + x + d] - g[y * 24 + x]) * 3) for y in range(23) for x in range(23) for d in (1, 24)]

    mae = min(1, sum(abs(p - q) for p, q in zip(a[1], b[1])) / 432 / 255)
    return max(0, min(1, 0.5 * (corr(a[0], b[0]) + 1) / 2 + 0.32 * (corr(edge(a[0]), edge(b[0])) + 1) / 2 + 0.18 * (1 - mae)))


def test_fingerprints(spark):
    prints = {"p": print_of(3), "q": print_of(90, 7), "bad": (b"x", b"y")}
    refs = [("A", *print_of(3)), ("A", *print_of(200, 5)), ("B", *print_of(90, 7)), ("C", *print_of(10, 3)), ("D", b"x", b"y"), (None, *print_of(1))]
    df = spark.createDataFrame([(k, *v) for k, v in prints.items()], "id string, gray binary, color binary")
    ranked = fingerprint.ranked_matches(df, spark.createDataFrame(refs, "canonical string, gray binary, color binary"), 3)
    got = {(r.id, r.canonical): r.score for r in ranked.collect()}
    for k, v in prints.items():
        for name in "ABC":
            want = 0.0 if k == "bad" else max(slow_similarity(v, r[1:]) for r in refs if r[0] == name)
            assert got[k, name] == pytest.approx(want, abs=1e-9)
    best = {r.id: (r.best, r.margin > 0) for r in fingerprint.best_two(ranked).collect()}
    assert best["p"] == ("A", True) and best["q"] == ("B", True) and best["bad"] == ("A", False)
    none = fingerprint.ranked_matches(df, spark.createDataFrame([], "canonical string, gray binary, color binary"))
    assert none.count() == 0


def test_codec_and_reuse(spark):
    from barterflow.operators.catalogue import carried_over

    df = spark.createDataFrame([("p", "i", *print_of(3))], "id string, image string, gray binary, color binary")
    assert fingerprint.decoded(fingerprint.encoded(df)).collect() == df.collect()
    wanted = spark.createDataFrame([("p", "i", "A"), ("p", "j", "A")], "id string, image string, canonical string")
    assert {(r.image, r.gray is not None) for r in carried_over(wanted, df).collect()} == {("i", True), ("j", False)}


def test_nearest_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [3.0, 2.0, 1.0]), (3, None), (4, [1.0])], "id bigint, v array<float>")
    r = spark.createDataFrame([(10, [2.0, 4.0, 6.5]), (20, [5.0, 1.0, 0.0])], "ref bigint, v array<float>")
    got = {(x.id, x.rank): (x.ref, round(x.score, 3)) for x in fingerprint.nearest_vectors(v, r).collect()}
    want = lambda a, b: round(float(np.corrcoef(a, b)[0, 1]), 3)
    assert got[1, 1] == (10, want([1, 2, 3], [2, 4, 6.5])) and got[2, 1] == (20, want([3, 2, 1], [5, 1, 0])) and got[3, 1] == (10, -1.0) and got[4, 1][1] == -1.0


def test_generic_images(spark):
    rows = [("u", 1, "求 ナツメ\n譲 アカギ", True), ("u", 2, "求 ナツメ×2\n譲 アカギ", False), ("v", 1, "求\nナツメ", False), ("w", 1, "なにも", True), ("w", 2, None, None)]
    df = spark.createDataFrame(rows, "url string, pass int, plain string, ok boolean")
    got = {r.url: (r.explicit, r.demand, r.supply) for r in evidence.generic_images(df, NAMES, []).collect()}
    assert got == {"u": (True, ["ナツメ", "ナツメ"], ["アカギ"]), "v": (True, ["ナツメ"], []), "w": (False, [], [])}
    got = {r.url: r.explicit for r in evidence.generic_images(df, NAMES, [], "ok").collect()}
    assert got == {"u": True, "v": False, "w": False}


def test_images_replace_or_join_text(spark):
    urls = spark.createDataFrame([("1", ["a", "b"]), ("2", ["b"]), ("3", ["c", "a"]), ("4", [])], "id string, urls array<string>")
    known = spark.createDataFrame([("a", True, True, ["アカギ"], []), ("b", False, True, ["ナツメ", "ナツメ"], ["カイ"]), ("c", True, False, [], [])], "url string, layout boolean, explicit boolean, demand array<string>, supply array<string>")
    of = {r.id: r for r in evidence.images_of_posts(urls, known).collect()}
    assert (of["1"].demand, of["1"].authoritative, of["1"].image_count) == (["アカギ"], True, 2)
    assert (of["2"].demand, of["2"].supply, of["2"].authoritative) == (["ナツメ", "ナツメ"], ["カイ"], False)
    parsed = spark.createDataFrame([("1", ["マオ"], ["カイ"], True), ("2", ["ナツメ"], ["マオ"], True), ("5", ["カイ"], [], True), ("6", [], [], False)], "id string, demand array<string>, supply array<string>, explicit boolean")
    got = {r.id: (r.demand, r.supply, r.parsed_from) for r in evidence.with_images(parsed, evidence.images_of_posts(urls, known)).collect()}
    assert got == {"1": (["アカギ"], [], "layout-image"), "2": (["ナツメ", "ナツメ"], ["マオ", "カイ"], "text+image"), "5": (["カイ"], [], "text")}
    empty = known.withColumns({"layout": F.lit(True), "demand": F.array().cast("array<string>"), "supply": F.array().cast("array<string>")})
    assert {r.id for r in evidence.with_images(parsed, evidence.images_of_posts(urls, empty)).collect()} == {"5"}
    assert evidence.image_statistics(known).first().layout == 2


def test_image_cache(spark):
    from datetime import datetime, timezone

    now = datetime(2026, 1, 2, tzinfo=timezone.utc)
    cache = spark.createDataFrame([("a", 10, datetime(2026, 1, 1, 12, tzinfo=timezone.utc)), ("b", 9, now), ("c", 10, datetime(2025, 1, 1, tzinfo=timezone.utc))], "url string, cache_version int, checked_at timestamp")
    fresh = evidence.fresh(cache, now, 10, 24)
    assert [r.url for r in fresh.collect()] == ["a"]
    made = []

    def recognise(todo):
        made.extend(r.url for r in todo.collect())
        return todo

    urls = spark.createDataFrame([("a",), ("b",), ("d",), ("e",)], "url string")
    known, after = evidence.recognised(urls, cache, recognise, now, 10, 24, 2)
    assert sorted(r.url for r in known.collect()) == ["a", "b", "d"] and after.count() == 3 and made == ["b", "d"]
    todo = evidence.to_recognise(spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "url string"), fresh)
    assert [r.url for r in todo.collect()] == ["b"]


def test_image_links(spark):
    doc = '{"media":[{"imageUrl":"https://h.example/1"},{"thumbnail":"https://h.example/2"},{"x":"https://h.example/3.png?a"},{"x":"https://h.example/4"}],"y":"https://pbs.twimg.com/m/z?format=jpg&name=small"}'
    want = ["https://h.example/1", "https://h.example/2", "https://h.example/3.png?a", "https://pbs.twimg.com/m/z?format=jpg&name=orig"]
    assert images.image_links(doc) == want and images.image_links(None) == [] and images.image_links("{") == []
    rows = spark.createDataFrame([(doc,), (None,)], "d string").select(images.image_urls("d").alias("u")).collect()
    assert [r.u for r in rows] == [want, []]


def test_layout_and_pixels(spark):
    x = np.full((400, 300, 3), 240, np.uint8)
    x[40:60] = (230, 90, 160)
    x[200:220] = (60, 150, 230)
    x[380:] = 0
    got = images.trade_layout(x)
    assert (got["pink_top"], got["blue_bottom"], got["content_bottom"]) == (0.1, 0.55, 0.95)
    assert images.trade_layout(np.full((400, 300, 3), 240, np.uint8)) is None and images.trade_layout(x[:100]) is None
    gray, color = images.pixel_fingerprint(x)
    assert len(gray) == 576 and len(color) == 432 and images.pixel_fingerprint(x[:20]) is None
    files = spark.createDataFrame([("p", b"1"), ("q", b"")], "path string, content binary")

    def make():
        return lambda content: [(1, content.decode() * 2, 90.0, False)] if content else 1 / 0

    assert {(r.path, r.text) for r in images.readings(files, make).collect()} == {("p", "11"), ("q", None)}

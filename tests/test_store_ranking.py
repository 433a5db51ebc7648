from __future__ import annotations

from datetime import datetime, timedelta, timezone

from barterflow.operators import catalogue, multiset, ranking, store
from barterflow.plans.posts import kept_posts
from barterflow.sources.files import snapshot

POSTS = "id string, created_at timestamp, demand array<string>, supply array<string>"
UTC = timezone.utc


def at(day: int, hour: int, minute: int = 0) -> datetime:
    return datetime(2026, 10, day, hour, minute, tzinfo=UTC)


def cards(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "name string")


def ranked(spark, posts, names, now):
    return ranking.rankings(ranking.name_counts(posts, cards(spark, *names), now)).orderBy("window_key", "rank").collect()


def test_order(spark):
    posts = spark.createDataFrame([(None, at(2, 23), ["ナツメ", "ナツメ"], ["ナツメ"]), (None, at(2, 22), ["アカギ", "アカギ"], []), (None, at(2, 21), ["カスミ"], None), (None, None, ["カスミ"], [None])], POSTS)
    rows = [r for r in ranked(spark, posts, ["ナツメ", "アカギ", "カスミ", "カイ"], at(3, 0)) if r.window_key == "24h"]
    assert [(r["rank"], r.name, r.demand, r.supply, r.ratio_display) for r in rows] == [(1, "アカギ", 2, 0, "∞"), (2, "ナツメ", 2, 1, "2.00"), (3, "カスミ", 1, 0, "∞")]


def test_windows_and_totals(spark):
    now = at(10, 10)
    posts = spark.createDataFrame([("1", at(10, 9), ["ナツメ"], ["カスミ"]), ("2", now - timedelta(hours=24), ["x"], None), ("3", now + timedelta(hours=1), [], []), ("4", now + timedelta(hours=1, seconds=1), ["ナツメ"], []), ("5", now - timedelta(hours=25), ["ナツメ"], [])], POSTS)
    counted = ranking.name_counts(posts, cards(spark, "ナツメ", "カスミ"), now)
    totals = {r.window_key: (r.posts, r.total_demand, r.total_supply) for r in ranking.window_totals(posts, counted, now).collect()}
    assert totals == {"24h": (3, 1, 1), "48h": (4, 2, 1), "168h": (4, 2, 1)}
    none = posts.where("false")
    assert {r.posts for r in ranking.window_totals(none, ranking.name_counts(none, cards(spark, "a"), now), now).collect()} == {0}
    doc = snapshot(ranking.rankings(counted), ranking.window_totals(posts, counted, now), store.coverage(posts), now)
    assert list(doc["windows"]) and doc["windows"]["24h"]["rankings"][0]["name"] == "ナツメ"


def test_bag_union_keeps_copies(spark):
    now = at(3, 6, 30)
    old = spark.createDataFrame([("1", at(3, 6), ["a"], [])], POSTS)
    assert store.united(old, old, now).count() == 2
    rows = spark.createDataFrame([("1", now - timedelta(hours=192), [], []), ("2", now - timedelta(hours=192, seconds=1), [], []), ("3", now + timedelta(hours=1), [], []), ("", now, [], []), (None, now, [], []), ("4", None, [], [])], POSTS)
    assert sorted(r.id for r in store.retained(rows, now).collect()) == ["1", "3"]


def test_requests_within(spark):
    now = at(3, 0)
    rows = spark.createDataFrame([((now - timedelta(hours=1)).isoformat(),), ((now - timedelta(hours=24)).isoformat(),), ((now + timedelta(hours=1)).isoformat(),), ("bad",), (None,), (now.isoformat(),)], "t string")
    assert store.requests_within(rows, "t", now).count() == 2


def test_last_and_first_wins(spark):
    rows = spark.createDataFrame([("a", 1, "x", [1]), ("a", 2, "y", None), ("b", 1, None, [2])], "k string, n int, v string, w array<int>")
    assert {(r.k, r.v) for r in store.last_wins(rows, ["k"], [rows.n]).collect()} == {("a", "y"), ("b", None)}
    assert {(r.k, r.v) for r in store.first_wins(rows, ["k"], [rows.n]).collect()} == {("a", "x"), ("b", None)}


def test_sources(spark):
    now = at(3, 0)
    rows = spark.createDataFrame([("1", at(2, 1), ["a", "a"], ["b"]), ("1", at(2, 2), ["c"], None), ("2", at(2, 3), ["Ax"], []), ("", at(2, 3), ["a"], [])], POSTS)
    got = {r.id: (r.created_at.hour, r.demand, r.supply) for r in ranking.sources(rows, now, 24).collect()}
    assert got == {"1": (1, ["a", "c"], ["b"]), "2": (3, ["Ax"], [])}
    assert [r.id for r in ranking.sources(rows, now, 24, card="Ax").collect()] == ["2"]
    assert sorted(r.id for r in ranking.sources(rows, now, 24, search=" aX ").collect()) == ["2"]
    assert [r.id for r in ranking.newest_sources(ranking.sources(rows, now, 24), 1).collect()] == ["2"]


def test_visible(spark):
    now = at(3, 0)
    rows = spark.createDataFrame([("1", at(2, 1), ["abc", "abc", "bcd"], ["xyz"])], POSTS)
    r = ranking.rankings(ranking.name_counts(rows, cards(spark, "abc", "bcd", "xyz"), now))
    assert [(x["rank"], x.name) for x in ranking.visible(r, "24h", "BC", 1).orderBy("rank").collect()] == [(1, "abc"), (2, "bcd")]
    assert [x.name for x in ranking.visible(r, "24h", "", 2).collect()] == ["abc"]
    assert ranking.chart_scale(r.where("false")).first().scale == 1


def test_multiset(spark):
    rows = spark.createDataFrame([(1, ["a", "a", "b", None], ["a", "c"]), (2, None, [])], "k int, x array<string>, y array<string>")
    assert [r.m for r in rows.select(multiset.merged(rows.x, rows.y).alias("m")).collect()] == [["a", "a", "b", "c"], []]
    both = multiset.counts(rows, "k", "x", "x").unionByName(multiset.counts(rows, "k", "y", "y"))
    assert {(r.k, *r.names) for r in multiset.listed(multiset.union_by_max(both, ["k"]), ["k"]).collect()} == {(1, "a", "a", "b", "c")}


def test_catalogue(spark):
    prints = spark.createDataFrame([("1", " A ", "T", "S", "R", "s1", "p", None, 1), ("2", "A", "T", "S", "R", "s2", None, "q", 2), ("3", "B", "T", "S", "R", "s1", None, None, 3), ("4", "C", "T", "X", "R", "s1", "p", None, 4), ("5", " ", "T", "S", "R", "s", "p", None, 5)], "id string, name string, type string, subtype string, rarity string, set_code string, image_png string, image string, pos int")
    chosen = catalogue.selected_prints(prints, "T", "S", "R")
    first = {(r.name, r.first_id, r.first_set, r.prints) for r in catalogue.first_prints(chosen, "pos").collect()}
    assert first == {("A", "1", "s1", 2), ("B", "3", "s1", 1)}
    names = spark.createDataFrame([("A", "あ"), ("C", "う")], "en string, ja string")
    conf = cards(spark, "う", "う", "え")
    found = catalogue.audited(chosen.select("name"), conf, names)
    assert {tuple(r) for r in found.collect()} == {("unknown", "B"), ("missing", "あ"), ("extra", "う"), ("extra", "え"), ("duplicate", "う")}
    assert "missing: あ" in catalogue.report(found)
    refs = catalogue.references(chosen, names, cards(spark, "あ"), "T", "S", "R")
    assert {(r.id, r.canonical, r.image) for r in refs.collect()} == {("1", "あ", "p"), ("2", "あ", "q")}
    assert catalogue.refresh_accepted(53, 82) and not catalogue.refresh_accepted(52, 82) and not catalogue.sane(999, 80)


def test_kept_posts(spark):
    rows = spark.createDataFrame([(1, "５", at(2, 2)), (2, "05", at(2, 1)), (3, "5 ", at(2, 1)), (4, None, at(2, 1)), (5, "6", None)], "hit_id bigint, id string, collected_at timestamp")
    assert sorted(r.hit_id for r in kept_posts(rows, [rows.hit_id]).collect()) == [2, 5]

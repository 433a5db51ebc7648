from __future__ import annotations

import json
from datetime import datetime, timezone

import pytest

from barterflow.operators.arrivals import SeenState
from barterflow.sources import files, pages
from barterflow.streaming.ingest import ingest_once, ingest_pages, page_stream

NAMES = ["ナツメ", "カイ"]


def page(n, query, entry, cursor=None, minute=0):
    return {"page_id": n, "query": query, "run_id": 1, "fetched_at": f"2026-01-01T00:{minute:02d}:00Z", "timeline": {"head": {"oldestTweetId": cursor}, "entry": entry}}


def entry(i, seconds=None, body="求:ナツメ 譲:カイ", user="u", url=None):
    return {"id": i, "url": url, "screenName": user, "createdAt": seconds, "displayTextBody": body}


def landed(spark, tmp_path, rows):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows))
    return pages.read_pages(spark, str(tmp_path / "in"))


def test_entries_and_cursors(spark, tmp_path):
    df = landed(spark, tmp_path, [page(1, "q", [], "123"), page(2, "q", [entry("5", 1760000000), entry("6", None)], None, 1), {"page_id": 3}, page(4, None, None)])
    assert {(r.page_id, r.next_cursor, r.entries) for r in pages.cursors(df).collect()} == {(1, "123", 0), (2, "6", 2), (4, None, 0)}
    assert sorted((r.page_id, r.pos, r.id) for r in pages.entries(df).collect()) == [(2, 0, "5"), (2, 1, "6")]


def test_parsed_and_accepted(spark, tmp_path):
    rows = [entry("5", 1760000000), entry("", 1760000000), entry(None, 1), entry("7", 1760000000, "求:ナツメ"), entry("8", 1760000000, user=None), entry("9", 1760000000, None), entry("10", None)]
    df = landed(spark, tmp_path, [page(1, "q", rows)])
    parsed = pages.parsed_entries(pages.entries(df), NAMES, [])
    assert sorted(r.id for r in parsed.collect()) == ["10", "5", "7", "8", "9"]
    assert sorted((r.id, r.url, r.demand[0], r.supply[0]) for r in pages.accepted(parsed).collect()) == [("10", "https://x.com/u/status/10", "ナツメ", "カイ"), ("5", "https://x.com/u/status/5", "ナツメ", "カイ")]


def test_last_page_wins_within_a_query(spark, tmp_path):
    df = landed(spark, tmp_path, [page(1, "q", [entry("5", 1)], "9", 0), page(2, "q", [entry("5", 2), entry("5", 3)], "8", 1), page(3, "r", [entry("5", 4)], None, 2)])
    assert sorted((r.query, r.created_raw) for r in pages.latest_by_id(pages.entries(df)).collect()) == [("q", 3), ("r", 4)]


def test_paging(spark, tmp_path):
    since = datetime.fromtimestamp(100, timezone.utc)
    rows = [
        page(1, "cut", [entry("1", 200)], "a", 0), page(2, "cut", [entry("2", 100)], "b", 1), page(3, "cut", [entry("3", 50)], "c", 2),
        page(4, "end", [entry("4", 300)], "a", 0), page(5, "end", [], None, 1), page(6, "end", [entry("9", 1)], "z", 2),
        page(7, "again", [entry("5", 300)], "a", 0), page(8, "again", [entry("6", 300)], "a", 1), page(9, "cap", [entry("7", 300)], "a", 0), page(10, "cap", [entry("8", 300)], "b", 1), page(11, "cap", [entry("8", 300)], "c", 2),
    ]
    df = pages.paging(landed(spark, tmp_path, rows), since, 2)
    got = {r.query: (r.pages, r.total_entries, r.reached_cutoff, r.exhausted, r.capped) for r in df.collect()}
    assert got == {"cut": (2, 2, True, False, False), "end": (2, 1, False, True, False), "again": (2, 2, False, True, False), "cap": (2, 2, False, False, True)}
    s = pages.backfill_summary(df.selectExpr("*", "query = 'end' AS failed")).first()
    assert (s.attempted, s.succeeded, s.failed, s.cutoff, s.exhausted, s.capped, s.complete) == (4, 3, 1, 1, 1, 1, False)


def test_reused(spark):
    found = spark.createDataFrame([("1", False), ("1", True), ("2", None)], "id string, sale boolean")
    known = spark.createDataFrame([("1", ["a"], [], datetime(2026, 1, 2)), ("1", ["b"], [], datetime(2026, 1, 1))], "id string, demand array<string>, supply array<string>, created_at timestamp")
    got = [(r.id, r.sale, r.known_demand, r.reused) for r in pages.reused(found, known, "sale").orderBy("id", "sale").collect()]
    assert got == [("1", False, ["b"], True), ("1", True, ["b"], False), ("2", None, None, False)]


def test_quota():
    assert pages.allocated(12, 72, 8, 10) == [5, 1, 1, 1, 1, 1, 1, 1]
    assert pages.page_quota(12, 0, 8, 10) == 0 and pages.page_quota(12, 3, 8, 10) == 1 and pages.page_quota(10, 9, 8, 10) == 2 and pages.page_quota(1, 1, 0, 1) == 0


def test_fetching():
    calls = []

    def source(query, cursor, results):
        calls.append((query, cursor, results))
        if query == "no":
            raise pages.AccessBlocked
        return {"timeline": {"head": {"oldestTweetId": "p2"}, "entry": [{"id": "1", "createdAt": 200 if cursor is None else 50}]}}

    at = lambda p: [e["createdAt"] for e in p["timeline"]["entry"]]
    got = pages.collected(source, ["q", "no", "r"], 5, 100, at)
    assert len(got) == 2 and calls == [("q", None, 40), ("q", "p2", 40), ("no", None, 40)]
    tries = []

    def flaky(query, cursor, results):
        tries.append(results)
        if len(tries) < 3:
            raise OSError
        return {}

    waits = []
    assert pages.fetched(flaky, "q", None, 99, 2, waits.append) == {} and tries == [40] * 3 and waits == [1200, 2400]
    with pytest.raises(OSError):
        pages.fetched(lambda *a: (_ for _ in ()).throw(OSError()), "q")


def test_name_queries(spark):
    cards = spark.createDataFrame([("カイ",)], "name string")
    aliases = spark.createDataFrame([("かい", "カイ"), ("x", "いない")], "alias string, canonical string")
    assert sorted(r.search_name for r in pages.name_queries(cards, aliases).collect()) == ["かい", "カイ"]


def test_files(spark, tmp_path):
    files.write_document(f"{tmp_path}/d/cards.json", {"cards": ["a"], "aliases": {"b": "a"}})
    assert files.read_document(f"{tmp_path}/none.json", 7) == 7
    c = files.Config.load(f"{tmp_path}/d")
    assert (c.cards, c.aliases, c.queries) == (("a",), (("b", "a"),), ())
    assert files.read_json(spark, f"{tmp_path}/none", "a int").count() == 0
    assert files.read_json(spark, f"{tmp_path}/d/cards.json", "cards array<string>").first().cards == ["a"]
    files.write_table(spark.range(3), f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 3
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "a.png").write_bytes(b"123")
    (tmp_path / "img" / "b.png").write_bytes(b"12345")
    assert [r.length for r in files.read_images(spark, f"{tmp_path}/img", 4).collect()] == [3]
    assert files.dictionary(spark.createDataFrame([], "cards array<string>, aliases array<struct<alias:string,canonical:string>>")) == ([], [])


def test_stream_of_pages(spark, tmp_path):
    landed(spark, tmp_path, [page(1, "q", [entry("5", 1760000000)]), page(2, "q", [entry("5", 1760000000), entry("6", 1760000000, "x")], None, 1)])
    ingest_pages(page_stream(spark, str(tmp_path / "in")), f"{tmp_path}/store", f"{tmp_path}/c", NAMES, []).awaitTermination()
    assert [r.id for r in spark.read.parquet(f"{tmp_path}/store").collect()] == ["5"]


def test_stream_exactly_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "row bigint, id string, at int"
    for n, rows in enumerate([[(1, "7", 2), (2, "07", 1)], [(3, "7", 0), (4, "8", 1), (5, None, 1)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        ingest_once(stream, f"file://{tmp_path}/s", f"{tmp_path}/out", f"{tmp_path}/c", "id", ["at"], "row", 3).awaitTermination()
    assert sorted(r.row for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [2, 4]


def landed_arrivals(spark, tmp_path, n, rows):
    spark.createDataFrame(rows, ARRIVALS).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")


def once(spark, tmp_path, checkpoint="c"):
    stream = spark.readStream.schema(ARRIVALS).parquet(f"{tmp_path}/in/*")
    ingest_once(stream, f"file://{tmp_path}/s", f"{tmp_path}/out", f"{tmp_path}/{checkpoint}", "id", ["at"], "row", 3).awaitTermination()
    return sorted(r.row for r in spark.read.parquet(f"{tmp_path}/out").collect())


ARRIVALS = "row bigint, id string, at int"


@pytest.mark.parametrize("committed", [False, True])
def test_stream_exactly_once_after_a_failure(spark, tmp_path, monkeypatch, committed):
    """The driver is lost just before, or just after, the second batch's bits are committed."""
    (tmp_path / "in").mkdir()
    landed_arrivals(spark, tmp_path, 0, [(1, "7", 2), (2, "07", 1)])
    assert once(spark, tmp_path) == [2]
    landed_arrivals(spark, tmp_path, 1, [(3, "7", 0), (4, "8", 1), (5, "8", 0)])
    commit = SeenState._commit

    def dies(self, *a, **k):
        if committed:
            commit(self, *a, **k)
        raise OSError("lost")

    monkeypatch.setattr(SeenState, "_commit", dies)
    with pytest.raises(Exception, match="lost"):
        once(spark, tmp_path)
    monkeypatch.setattr(SeenState, "_commit", commit)
    assert once(spark, tmp_path) == [2, 5]
    landed_arrivals(spark, tmp_path, 2, [(6, "8", 0), (7, "9", 0)])
    assert once(spark, tmp_path) == [2, 5, 7]


def test_stream_with_a_new_checkpoint(spark, tmp_path):
    (tmp_path / "in").mkdir()
    landed_arrivals(spark, tmp_path, 0, [(1, "7", 2)])
    assert once(spark, tmp_path) == [1]
    landed_arrivals(spark, tmp_path, 1, [(2, "7", 0), (3, "8", 0)])
    assert once(spark, tmp_path, "c2") == [1, 3]

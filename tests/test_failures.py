"""What happens when a part fails, is missing, or is asked for twice."""

from __future__ import annotations

import json
from datetime import datetime, timezone

import pytest

from barterflow import shared
from barterflow.operators import evidence
from barterflow.sources import files, images, pages

NOW = datetime(2026, 1, 2, tzinfo=timezone.utc)


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        def __init__(self, master):
            self.master = master

        def getConf(self):
            return {}

    class Session:
        def __init__(self, master):
            self.sparkContext, self.conf = Context(master), {}

    for master in ("spark://a:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared.shared_dir(Session(master))


def test_an_image_is_recognised_once(spark):
    made = spark.sparkContext.accumulator(0)

    def recognise(todo):
        def run(batches):
            for b in batches:
                made.add(b.num_rows)
                yield b

        return todo.mapInArrow(run, "url string")

    cache = spark.createDataFrame([("a", 1, NOW), ("old", 0, NOW)], "url string, cache_version int, checked_at timestamp")
    urls = spark.createDataFrame([("a",), ("b",), ("c",), ("c",), (None,)], "url string")
    known, after = evidence.recognised(urls, cache, recognise, NOW, 1, 24)
    assert sorted(r.url for r in known.collect()) == ["a", "b", "c"] and after.count() == 3 and known.count() == 3
    assert made.value == 2


def test_errors_of_a_recogniser_are_kept(spark):
    def make():
        def read(content):
            if content == b"bad":
                raise OSError("cut short")
            return [(0, "求", 0.5, True), (1, "譲", 0.25, False)] if content else []

        return read

    found = spark.createDataFrame([("a", b"ok"), ("b", b"bad"), ("c", b"")], "path string, content binary")
    got = sorted(((r.path, r["pass"], r.text, r.error) for r in images.readings(found, make).collect()), key=str)
    assert got == [("a", 0, "求", None), ("a", 1, "譲", None), ("b", None, None, "OSError: cut short")]
    assert {r.error for r in images.readings(found, make, task_seconds=-1.0).collect()} == {"budget"}


def test_statistics_of_nothing(spark):
    none = spark.createDataFrame([], "layout boolean, explicit boolean, demand array<string>, supply array<string>, passes bigint, error string, reused boolean, millis bigint")
    assert tuple(evidence.image_statistics(none).first()) == (0,) * 10
    assert evidence.image_statistics(none.drop("error")).first().failed is None
    assert tuple(evidence.cell_statistics(spark.createDataFrame([], "url string, card string, verified boolean, reason string")).first()) == (0,) * 9


def test_a_failed_job_is_recorded_and_the_next_goes_on():
    def source(query, cursor, results):
        if query == "no":
            raise pages.AccessBlocked("stop")
        if query == "late" and cursor:
            raise OSError("lost")
        return {"timeline": {"head": {"oldestTweetId": f"{cursor or ''}x"}, "entry": [{"id": "1", "createdAt": 50 if query == "cut" else 200}] if query != "end" else []}}

    times = lambda page: [e["createdAt"] for e in page["timeline"]["entry"]]
    read, jobs = pages.backfilled(source, [("cut", 3), ("no", 3), ("late", 3), ("end", 3), ("cap", 2)], 100, times)
    assert [(j["query"], j["pages"], j["reached_cutoff"], j["exhausted"], j["capped"], j["failed"]) for j in jobs] == [
        ("cut", 1, True, False, False, False), ("no", 0, False, False, False, True), ("late", 0, False, False, False, True), ("end", 1, False, True, False, False), ("cap", 2, False, False, True, False),
    ]
    assert [j["error"] for j in jobs if j["failed"]] == ["AccessBlocked: stop", "OSError: lost"]
    assert [p["query"] for p in read] == ["cut", "end", "cap", "cap"]


def test_text_of_an_entry_without_a_body(spark, tmp_path):
    page = {"page_id": 1, "query": "q", "run_id": 1, "fetched_at": "2026-01-01T00:00:00Z", "timeline": {"head": {}, "entry": [{"id": "1", "text": "old"}, {"id": "2", "text": "old", "displayTextBody": "new"}, {"id": "3"}]}}
    (tmp_path / "a.json").write_text(json.dumps(page))
    assert sorted((r.id, r.body) for r in pages.entries(pages.read_pages(spark, str(tmp_path))).collect()) == [("1", "old"), ("2", "new"), ("3", None)]


def test_rejected_bodies_are_left_out_before_parsing(spark, tmp_path):
    page = {"page_id": 1, "query": "q", "run_id": 1, "fetched_at": "2026-01-01T00:00:00Z", "timeline": {"head": {}, "entry": [{"id": "4194304000", "displayTextBody": x} for x in ("求:カ 譲:キ", "売 求:カ 譲:キ", None)]}}
    (tmp_path / "a.json").write_text(json.dumps(page))
    found = pages.entries(pages.read_pages(spark, str(tmp_path)))
    assert sorted(r.body for r in pages.parsed_entries(found, ["カ", "キ"], [], lambda b: b.contains("売")).collect()) == ["", "求:カ 譲:キ"]


def test_dictionary_of_several_rows_and_its_bound(spark, monkeypatch):
    cards = spark.createDataFrame([(["a", None, ""], [("x", "a")]), (["b", "a"], None)], "cards array<string>, aliases array<struct<alias:string,canonical:string>>")
    names, aliases = files.dictionary(cards)
    assert sorted(names) == ["a", "b"] and aliases == [("x", "a")]
    monkeypatch.setattr(files, "MOST_NAMES", 1)
    with pytest.raises(ValueError, match="more than 1"):
        files.dictionary(cards)


def test_tuning_is_filled_in(tmp_path):
    (tmp_path / "history.json").write_text('{"retryCount": 2}')
    (tmp_path / "cards.json").write_text('{"cards": ["a"], "aliases": {"x": "a"}}')
    c = files.Config.load(str(tmp_path))
    assert (c.cards, c.aliases, c.queries, c.tuning["retryCount"], c.tuning["resultsPerPage"]) == (("a",), (("x", "a"),), (), 2, 40)
    assert files.Config.load(str(tmp_path / "none")).tuning == files.TUNING


def test_snapshot_with_state(spark):
    rankings = spark.createDataFrame([], "window_key string, rank bigint, name string, demand bigint, supply bigint, ratio double, ratio_display string, ratio_sort double, imbalance bigint")
    totals = spark.createDataFrame([("24h", 24, 2, 0, 0, 0.0, "0.00", 0.0)], "window_key string, hours int, posts bigint, total_demand bigint, total_supply bigint, total_ratio double, total_ratio_display string, total_ratio_sort double")
    coverage = spark.createDataFrame([(NOW, NOW, 2)], "oldest timestamp, newest timestamp, stored bigint")
    d = files.snapshot(rankings, totals, coverage, NOW, {"platform": "P"}, {"count": 3}, {"lastBackfill": {"n": 1}}, 5, 8, ["e"])
    assert d["source"] == {"platform": "P"} and d["cards"] == {"count": 3}
    assert {k: d["coverage"][k] for k in ("firstSuccessfulCollectionAt", "discoveredThisRun", "queryCount", "errors", "history", "imageOcr")} == {"firstSuccessfulCollectionAt": NOW.isoformat(), "discoveredThisRun": 5, "queryCount": 8, "errors": ["e"], "history": {"n": 1}, "imageOcr": None}
    assert files.next_state({"kept": 1}, d) == {"kept": 1, "firstSuccessfulCollectionAt": NOW.isoformat(), "lastRunAt": NOW.isoformat(), "lastRunDiscovered": 5, "lastRunErrors": ["e"]}
    assert files.snapshot(rankings, totals, spark.createDataFrame([(None, None, 0)], coverage.schema), NOW)["coverage"]["firstSuccessfulCollectionAt"] is None

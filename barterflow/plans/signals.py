"""Queries of the engine's own operators over the tables of the domain."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barterflow.functions.ids import sequence_millis
from barterflow.functions.text import STATUS_EPOCH_MS, author, clean_text, entry_time, entry_url, status_id, strip_highlight
from barterflow.operators import catalogue, consensus, fingerprint, multiset, ranking, store
from barterflow.operators.extract import BODY_MARK, body_text, segments
from barterflow.operators.pigeonhole import within_edits
from barterflow.plans.posts import card_names, mentions, table
from barterflow.sources import pages
from barterflow.sources.files import dictionary

#: The moment the windows end: a parameter of every operator, fixed here so that results can be compared.
NOW = datetime(2026, 9, 28, 12, tzinfo=timezone.utc)
SINCE = datetime(2026, 9, 21, 12, tzinfo=timezone.utc)
MOST_PAGES = 10


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.entries(table(spark, sf_dir, "timelines"))


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.name_counts(table(spark, sf_dir, "posts"), card_names(spark, sf_dir), NOW)


def _shown(ranked: DataFrame) -> DataFrame:
    return ranked.withColumns({"ratio": F.round("ratio", 6), "ratio_sort": F.round("ratio_sort", 6)})


def name_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir)


def rank_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rankings(_counts(spark, sf_dir))


def rank_windows_codepoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(ranking.rankings(_counts(spark, sf_dir), collation=""))


def window_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = table(spark, sf_dir, "posts")
    out = ranking.window_totals(posts, _counts(spark, sf_dir), NOW)
    return out.withColumns({"total_ratio": F.round("total_ratio", 6), "total_ratio_sort": F.round("total_ratio_sort", 6)})


def visible_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(ranking.visible(ranking.rankings(_counts(spark, sf_dir), ""), "168h", "ー", 1, ""))


def chart_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.chart_scale(_counts(spark, sf_dir).where("window_key = '168h'"))


def retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.retained(table(spark, sf_dir, "posts"), NOW).select("hit_id", "id")


def bag_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of each id after the union of what two overlapping groups of runs collected: rows of every third run, and of no known run, are in both."""
    posts = table(spark, sf_dir, "posts")
    third = (F.col("run_id") % 3 == 0) | F.col("run_id").isNull()
    return store.united(posts.where(third | (F.col("run_id") % 2 == 0)), posts.where(third | (F.col("run_id") % 2 != 0)), NOW).groupBy("id").agg(F.count("*").alias("copies"))


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.coverage(store.retained(table(spark, sf_dir, "posts"), NOW)).select(F.unix_millis("oldest").alias("oldest"), F.unix_millis("newest").alias("newest"), "stored", "distinct_ids", F.round("hours", 4).alias("hours"))


def rolling_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages read in the day before now."""
    return store.requests_within(table(spark, sf_dir, "timelines"), "fetched_at", NOW).select("page_id", "query")


def stored_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = store.stored(table(spark, sf_dir, "posts"))
    return posts.select("id", F.unix_millis("created_at").alias("ms"), F.array_join("demand", "|", "-").alias("demand"), F.array_join("supply", "|", "-").alias("supply"))


def source_drilldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranking.sources(table(spark, sf_dir, "posts"), NOW, 168)
    return found.select("id", F.unix_millis("created_at").alias("ms"), F.array_join("demand", "|").alias("demand"), F.array_join("supply", "|").alias("supply"))


def newest_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest hundred posts behind the last week that hold one card (a top-k report)."""
    found = ranking.sources(table(spark, sf_dir, "posts"), NOW, 168, card="ルモカ")
    return ranking.newest_sources(found).select("id", F.unix_millis("created_at").alias("ms"))


def multiset_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each post and name the larger count of its two lists."""
    posts = table(spark, sf_dir, "posts")
    both = multiset.counts(posts, "hit_id", "demand", "demand").unionByName(multiset.counts(posts, "hit_id", "supply", "supply"))
    return multiset.union_by_max(both, ["hit_id"])


def page_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).select("page_id", F.col("pos").cast("bigint").alias("pos"), "id", "screen_name", "created_raw")


def page_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.cursors(table(spark, sf_dir, "timelines")).select("page_id", F.col("entries").cast("bigint").alias("entries"), "next_cursor")


def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.latest_by_id(_entries(spark, sf_dir)).select("run_id", "query", "id", "page_id", F.col("pos").cast("bigint").alias("pos"))


def query_paging(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pages.paging(table(spark, sf_dir, "timelines"), SINCE, MOST_PAGES)
    return out.withColumn("oldest", F.unix_millis("oldest")).withColumnRenamed("oldest", "oldest_ms")


def backfill_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job is a query of a run; of those without a search or a run, and of every seventh run, it counts as failed."""
    jobs = pages.paging(table(spark, sf_dir, "timelines"), SINCE, MOST_PAGES).withColumn("failed", F.col("query").isNull() | F.col("run_id").isNull() | (F.col("run_id") % 7 == 0))
    return pages.backfill_summary(jobs).withColumn("oldest", F.unix_millis("oldest")).withColumnRenamed("oldest", "oldest_ms")


def name_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = table(spark, sf_dir, "cards")
    aliases = cards.select(F.explode("aliases").alias("a")).select("a.alias", "a.canonical")
    return pages.name_queries(card_names(spark, sf_dir), aliases)


def highlight_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).select("page_id", F.col("pos").cast("bigint").alias("pos"), strip_highlight("body").alias("body"))


def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", clean_text("text").alias("text"))


def entry_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    link = entry_url("url", "screen_name", "id")
    return _entries(spark, sf_dir).select("page_id", F.col("pos").cast("bigint").alias("pos"), link.alias("url"), status_id(link).alias("status_id"), author(link).alias("author"))


def entry_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).select("page_id", F.col("pos").cast("bigint").alias("pos"), F.unix_millis(entry_time("created_raw", "id")).alias("ms"))


def id_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "posts").select("hit_id", sequence_millis("id", STATUS_EPOCH_MS).alias("ms"))


def body_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entries(spark, sf_dir).select("page_id", "pos", F.explode(segments(body_text(strip_highlight("body")), BODY_MARK)).alias("s"))
    return e.select("page_id", "pos", "s.kind", "s.text")


def parsed_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the accepted entries want and offer."""
    names, aliases = dictionary(table(spark, sf_dir, "cards"))
    out = pages.accepted(pages.parsed_entries(_entries(spark, sf_dir), names, aliases))
    lists = [F.array_join(F.array_sort(c), "|").alias(c) for c in ("demand", "supply")]
    return out.select("page_id", F.col("pos").cast("bigint").alias("pos"), "id", F.unix_millis("created_at").alias("ms"), "url", "author", *lists)


def title_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of an author's entries as readings of one cell: the title they agree on."""
    cards = table(spark, sf_dir, "cards")
    aliases = cards.select(F.explode("aliases").alias("a")).select("a.alias", "a.canonical")
    passes = _entries(spark, sf_dir).where("screen_name IS NOT NULL").select(F.col("screen_name").alias("cell_id"), F.struct("page_id", "pos").alias("pass"), F.col("body").alias("text"), F.lit(0.0).alias("confidence"))
    return consensus.consensus(consensus.voted(consensus.title_matches(passes, consensus.title_variants(card_names(spark, sf_dir), aliases))))


def fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in the lists that the dictionary doesn't have, with its names at most six edits away."""
    posts = table(spark, sf_dir, "posts")
    cards = card_names(spark, sf_dir)
    other = posts.select(F.explode(mentions()).alias("other")).where("other <> ''").distinct().join(cards.select(F.col("name").alias("other")), "other", "left_anti")
    met = within_edits(other.withColumnRenamed("other", "value"), cards.withColumnRenamed("name", "ref"), [(None, 6)])
    return met.select(F.col("value").alias("other"), F.col("ref").alias("name"), F.col("distance").cast("bigint").alias("distance"))


def label_means(v: DataFrame) -> DataFrame:
    """ref, v: the mean vector of each label."""
    means = v.where("label IS NOT NULL").select("label", F.posexplode("embedding")).groupBy("label", "pos").agg(F.avg("col").alias("x"))
    return means.groupBy(F.col("label").cast("bigint").alias("ref")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("v"))


def vector_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two labels whose mean vector each vector correlates with most."""
    v = table(spark, sf_dir, "embeddings")
    ranked = fingerprint.nearest_vectors(v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), label_means(v))
    return ranked.select("id", "rank", "ref", F.round("score", 5).alias("score"))


def catalogue_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in the lists against the dictionary, both ways."""
    names = table(spark, sf_dir, "posts").select(F.explode(mentions()).alias("name")).where("name IS NOT NULL").distinct()
    cards = table(spark, sf_dir, "cards").select(F.explode("cards").alias("name"))
    return catalogue.audited(names, cards, cards.select(F.col("name").alias("en"), F.col("name").alias("ja")))


def busy_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of two days or more on which a search had more hits than on its average day."""
    posts = table(spark, sf_dir, "posts").where("query IS NOT NULL AND created_at IS NOT NULL")
    daily = posts.groupBy("query", F.datediff(F.to_date("created_at"), F.lit("2026-01-01").cast("date")).alias("n")).agg(F.count("*").alias("hits"))
    mean = daily.groupBy("query").agg(F.avg("hits").alias("mean"))
    scored = daily.join(mean, "query").withColumn("score", F.col("hits") / F.col("mean"))
    out = consensus.runs(scored, "query", "n", "score", 1.0, 2)
    return out.select("query", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), F.round("score", 6).alias("score"))


QUERIES = {
    f.__name__: f
    for f in (
        name_counts, rank_windows, rank_windows_codepoint, window_totals, visible_ranking, chart_scale, retained, bag_union, coverage, rolling_budget, stored_posts, source_drilldown, newest_sources, multiset_max,
        page_entries, page_cursors, last_wins, query_paging, backfill_summary, name_queries, highlight_stripped, clean_documents, entry_links, entry_times, id_times, body_segments, parsed_posts, title_consensus,
        fuzzy_names, vector_matches, catalogue_audit, busy_stretches,
    )
}

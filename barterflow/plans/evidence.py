"""Queries of the operators over readings, images, catalogues and sources.

The tables of the domain hold no images. Readings of images, recognitions, fingerprints and prints are
derived from whole tables by the rules stated here, so that SQL can compute the same.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barterflow.functions.ids import number_key
from barterflow.functions.numeric import grid_rows, span_display
from barterflow.functions.text import has_unnegated, likely_trade_image, nfkc, star_marker, strip_highlight
from barterflow.operators import catalogue, consensus, evidence, fingerprint, ranking, store
from barterflow.operators.arrivals import first_arrivals
from barterflow.plans.posts import card_names, mentions, table
from barterflow.plans.signals import NOW, label_means
from barterflow.shared import fresh_path
from barterflow.sources import files, images, pages
from barterflow.streaming.ingest import ingest_once, ingest_pages, page_stream

#: Searches of a run at most. Phrases a body is left out for, and the same ones negated: parameters of has_unnegated, neutral here.
MOST_SEARCHES = 10_000
PHRASES, NEGATED = ("複数可", "お返事おそめ"), ("複数可ではない",)


def joined(names: Column | str) -> Column:
    """A list of names as sorted text."""
    return F.array_join(F.array_sort(names), "|")


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.entries(table(spark, sf_dir, "timelines"))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, aliases = files.dictionary(table(spark, sf_dir, "cards"))
    return pages.parsed_entries(_entries(spark, sf_dir), names, aliases, lambda body: has_unnegated(body, NEGATED, PHRASES))


def unnegated_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).select("page_id", F.col("pos").cast("bigint").alias("pos"), has_unnegated(strip_highlight("body"), NEGATED, PHRASES).alias("found"))


def trade_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that look as if they came with a trade sheet."""
    likely = likely_trade_image("body", F.array("url"), ("求", "希望"), ("譲", "出", "提供"), ("x.com/a", "example.org"))
    return _entries(spark, sf_dir).select("page_id", F.col("pos").cast("bigint").alias("pos"), likely.alias("likely"))


def star_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rows are marked with two stars. Derived: the mark by hit_id."""
    mark = F.element_at(F.array(*[F.lit(x) for x in ("★2", "☆☆", "星 ２", "2 Stars", "★3", "☆")]), (F.col("hit_id") % 6 + 1).cast("int"))
    text = F.concat(F.coalesce("query", F.lit("")), F.lit(" "), mark)
    return table(spark, sf_dir, "posts").select("hit_id", star_marker(nfkc(text)).alias("marked"))


def reused_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with the lists of the first stored post of their id."""
    known = table(spark, sf_dir, "posts").where("id <> '' AND created_at IS NOT NULL").withColumn("seq", F.col("hit_id"))
    found = _entries(spark, sf_dir).withColumn("rejected", has_unnegated(strip_highlight("body"), NEGATED, PHRASES))
    out = pages.reused(found, known, "rejected")
    return out.select("page_id", F.col("pos").cast("bigint").alias("pos"), "reused", joined("known_demand").alias("demand"), joined("known_supply").alias("supply"))


def _recognitions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Urls (the entries' ids) and a cache of earlier recognitions. Derived: what was stored of an id, its version by its first hit_id."""
    posts = table(spark, sf_dir, "posts").where("id <> ''")
    cache = posts.groupBy(F.col("id").alias("url")).agg(F.count("*").alias("passes"), F.max("collected_at").alias("checked_at"), F.min("hit_id").alias("first"))
    cache = cache.select("url", "passes", F.lit(True).alias("reused"), "checked_at", (F.col("first") % 3).cast("int").alias("cache_version"))
    return _entries(spark, sf_dir).select(F.col("id").alias("url")), cache


def recognitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognitions of all urls: fresh ones of the cache, the others made (derived: as many passes as the url has characters)."""
    urls, cache = _recognitions(spark, sf_dir)
    made = lambda todo: todo.select("url", F.length("url").cast("bigint").alias("passes"), F.lit(False).alias("reused"))
    known, _ = evidence.recognised(urls, cache, made, NOW, 1, 216 * 12)
    return known.select("url", "passes", "reused")


def image_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over recognitions. Derived: a row of posts is an image."""
    posts = table(spark, sf_dir, "posts")
    none = F.array().cast("array<string>")
    made = posts.select(
        (F.col("hit_id") % 3 == 0).alias("layout"), F.col("query").isNotNull().alias("explicit"), F.coalesce("demand", none).alias("demand"), F.coalesce("supply", none).alias("supply"),
        (F.col("hit_id") % 5).alias("passes"), F.when(F.col("author").isNull(), "unread").alias("error"), (F.col("hit_id") % 4 == 0).alias("reused"), (F.col("hit_id") % 100).alias("millis"),
    )
    return evidence.image_statistics(made)


def read_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What images say, over all their readings. Derived: a post's copies are readings of one image; the text is made of its lists in five layouts."""
    text = lambda c, by: F.coalesce(F.array_join(c, by), F.lit(""))
    layouts = [
        F.concat(F.lit("求 "), text("demand", "、"), F.lit("\n譲 "), text("supply", "、")),
        F.concat(F.lit("欲しぃカ一ド\n"), text("demand", "\n"), F.lit("\n譲れろ力ード】"), text("supply", "｜")),
        F.concat(F.lit("希望 "), text("demand", "×２、")),
        F.concat(F.lit("出： "), text("supply", " 3枚 ")),
        text("demand", "、"),
    ]
    plain = F.element_at(F.array(*layouts), (F.col("hit_id") % 5 + 1).cast("int"))
    passes = table(spark, sf_dir, "posts").where("id <> ''").select(F.col("id").alias("url"), F.col("hit_id").alias("pass"), nfkc(plain).alias("plain"), (F.col("hit_id") % 4 != 0).alias("star"))
    names, aliases = files.dictionary(table(spark, sf_dir, "cards"))
    out = evidence.generic_images(passes, names, aliases, "star")
    return out.select("url", "explicit", joined("demand").alias("demand"), joined("supply").alias("supply"))


def _images_of_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived: the first five copies of a post are its images, a third of them of the known layout."""
    rows = table(spark, sf_dir, "posts").where("id <> ''").select("id", "hit_id", "demand", "supply", F.col("hit_id").cast("string").alias("url"))
    first = store.top_rows(rows.select("id", "hit_id", "url"), ["id"], [F.col("hit_id")], 5)
    urls = first.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("hit_id", "url"))), lambda x: x["url"]).alias("urls"))
    known = rows.select("url", (F.col("hit_id") % 3 == 0).alias("layout"), F.col("demand").isNotNull().alias("explicit"), "demand", "supply")
    return evidence.images_of_posts(urls, known)


def image_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _images_of_posts(spark, sf_dir)
    return out.select("id", joined("demand").alias("demand"), joined("supply").alias("supply"), "explicit", "image_count", "authoritative")


def posts_with_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries' text and their images' evidence put together."""
    parsed = _parsed(spark, sf_dir).select("page_id", F.col("pos").cast("bigint").alias("pos"), "id", "demand", "supply", "explicit")
    out = evidence.with_images(parsed, _images_of_posts(spark, sf_dir))
    return out.select("page_id", "pos", "id", joined("demand").alias("demand"), joined("supply").alias("supply"), "parsed_from", "image_count", "authoritative")


def _title_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived: a row of posts is a cell, its title the first name wanted (or offered), read five times, each time damaged by rule."""
    base, other = F.coalesce(F.get("demand", F.lit(0)), F.get("supply", F.lit(0))), F.coalesce(F.get("supply", F.lit(0)), F.lit(""))
    cells = table(spark, sf_dir, "posts").select("hit_id", base.alias("base"), other.alias("other"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("pass")).where("base IS NOT NULL")
    text = "array(base, base, substring(base, 1, length(base) - 1), concat(base, ' ×２'), concat(base, '枚'), substring(base, 2), concat(base, '\n', other))[(hit_id + pass) % 7]"
    return cells.select(F.col("hit_id").alias("cell_id"), "pass", F.expr(text).alias("text"), ((F.col("hit_id") * 7 + F.col("pass") * 13) % 100 / 100).alias("confidence"))


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = table(spark, sf_dir, "cards").select(F.explode("aliases").alias("a")).select("a.alias", "a.canonical")
    return consensus.title_matches(_title_passes(spark, sf_dir), consensus.title_variants(card_names(spark, sf_dir), aliases))


def title_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best title of each reading."""
    return _titles(spark, sf_dir).select("cell_id", "pass", "canonical", "exact", F.col("distance").cast("bigint").alias("distance"), F.round("score", 6).alias("score"), "confidence")


def title_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = consensus.voted(_titles(spark, sf_dir))
    return votes.select("cell_id", "canonical", "votes", "exact_votes", F.round("avg_score", 6).alias("avg_score"), F.round("avg_confidence", 6).alias("avg_confidence"), F.col("best_distance").cast("bigint").alias("best_distance"))


def agreed_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.consensus(consensus.voted(_titles(spark, sf_dir)))


def badge_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which cells show the badge. Derived: three or five readings of each row of posts, the measures by hit_id."""
    posts = table(spark, sf_dir, "posts").select("hit_id")
    readings = posts.select(F.col("hit_id").alias("cell_id"), F.explode(F.sequence(F.lit(0), (F.col("hit_id") % 2 * 2 + 2).cast("int"))).alias("pass"))
    readings = readings.select("cell_id", F.expr("array('2', '１２', '1', '', '３', 'x2', '21')[(cell_id * 3 + pass) % 7]").alias("text"))
    metrics = posts.select(F.col("hit_id").alias("cell_id"), (F.col("hit_id") % 50 / 100).alias("dark_ratio"), (F.col("hit_id") % 9 / 1000).alias("yellow_ratio"))
    return consensus.badges(readings, metrics)


def shown_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells worth reading. Derived: the four measures are columns of lineitem."""
    m = [F.col("l_quantity") / 12, F.col("l_discount") * 200, F.col("l_extendedprice") / 15000, F.col("l_tax") * 400]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", consensus.visual_gate(*m).alias("shown"))


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived: a vector is a cell, the labels' mean vectors are the references, its own label or the next one the title read."""
    v = table(spark, sf_dir, "embeddings")
    ranked = fingerprint.nearest_vectors(v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), label_means(v)).withColumn("canonical", F.concat(F.lit("L"), "ref"))
    best = fingerprint.best_two(ranked).join(v.select(F.col("vec_id").alias("id"), "label"), "id")
    read = F.when(F.col("id") % 3 == 1, F.concat(F.lit("L"), "label")).when(F.col("id") % 3 == 2, F.concat(F.lit("L"), F.col("label") % 9))
    return best.select("id", "margin", *consensus.visual_decision(read, F.col("best"), F.col("best_score"), F.col("second_score"), 0.3, 0.2))


def card_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decisions(spark, sf_dir).select("id", "card", "reason", F.round("margin", 5).alias("margin"))


def cell_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over decided cells. Derived: ten cells an image, every fourth badge unverified."""
    return evidence.cell_statistics(_decisions(spark, sf_dir).select(F.floor(F.col("id") / 10).alias("url"), "card", (F.col("id") % 4 != 0).alias("verified"), "reason"))


def fingerprint_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two labels whose fingerprint each fingerprint is most like. Derived: bytes of a vector; a label's reference is its first vector, sent as base64."""
    gray = "unhex(array_join(transform(sequence(0, 575), i -> lpad(hex((floor(abs(cast(embedding[i % 64] AS double)) * 900) + i * (vec_id % 3)) % 256), 2, '0')), ''))"
    color = "unhex(array_join(transform(sequence(0, 431), i -> lpad(hex((floor(abs(cast(embedding[(i * 5) % 64] AS double)) * 1200) + i) % 256), 2, '0')), ''))"
    v = table(spark, sf_dir, "embeddings")
    prints = v.select(F.col("vec_id").cast("string").alias("id"), F.expr(gray).alias("gray"), F.expr(color).alias("color"))
    first = v.where("label IS NOT NULL").groupBy("label").agg(F.min("vec_id").cast("string").alias("id"))
    references = fingerprint.decoded(fingerprint.encoded(prints.join(first, "id").select(F.concat(F.lit("L"), "label").alias("canonical"), "gray", "color")))
    ranked = fingerprint.ranked_matches(prints, references)
    return ranked.select("id", "rank", "canonical", F.round("score", 5).alias("score"))


def grid_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a card grid. Derived: the measures are columns of lineitem."""
    pitch = F.when(F.col("l_linenumber") != 7, F.col("l_quantity") * 3 - 3)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", grid_rows(F.col("l_extendedprice") / 50, pitch, pitch * 1.36).alias("rows"))


def run_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The span of time each search's run covers, as shown."""
    posts = table(spark, sf_dir, "posts").where("created_at IS NOT NULL")
    hours = (F.unix_micros(F.max("created_at")) - F.unix_micros(F.min("created_at"))) / 3.6e9
    return posts.groupBy("query", "run_id").agg(hours.alias("hours")).select("query", "run_id", span_display(F.col("hours")).alias("span"))


def _prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived: a part is a print, its brand the English name."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id", "concat(' ', p_brand) AS name", "p_type AS type", "if(p_size > 25, 'big', 'small') AS subtype", "concat('R', p_partkey % 3) AS rarity", "p_name AS set_code",
        "if(p_partkey % 5 = 0, '', concat('img/', p_partkey)) AS image_png", "if(p_partkey % 10 = 0, concat('alt/', p_partkey), NULL) AS image",
    )


def _name_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived: brands whose number doesn't end in 7 have a Japanese name; those that end in 1 and 3 share one."""
    return table(spark, sf_dir, "part").select("p_brand").distinct().selectExpr("p_brand AS en", "CASE WHEN p_brand LIKE '%7' THEN NULL WHEN p_brand LIKE '%3' THEN concat('和', left(p_brand, length(p_brand) - 1), '1') ELSE concat('和', p_brand) END AS ja")


def _configured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived: the Japanese names but those of brands that end in 4, those that end in 2 twice, and two names of no brand."""
    named = _name_map(spark, sf_dir).where("ja IS NOT NULL AND NOT ja LIKE '%4'").select(F.col("ja").alias("name")).distinct()
    return named.unionByName(named.where("name LIKE '%2'")).unionByName(spark.createDataFrame([("和余り",), ("和余り2",)], "name string"))


def _selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.selected_prints(_prints(spark, sf_dir), "PROMO", "big", "R1")


def print_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.first_prints(_selected(spark, sf_dir), "id")


def translated_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue in English against a dictionary in Japanese: unknown, missing, extra and duplicate names all occur."""
    return catalogue.audited(_selected(spark, sf_dir).select("name"), _configured(spark, sf_dir), _name_map(spark, sf_dir))


def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(catalogue.report(translated_audit(spark, sf_dir)),)], "report string")


def catalogue_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of the catalogue, with the fingerprints an older set has for them (derived: of every other print, under an older image for every sixth)."""
    prints = _prints(spark, sf_dir).withColumn("name", F.trim("name"))
    wanted = catalogue.references(prints, _name_map(spark, sf_dir), _configured(spark, sf_dir), "PROMO", "big", "R1")
    old = prints.where("id % 2 = 0").selectExpr("cast(id AS string) AS id", "if(id % 6 = 0, 'img/old', concat('img/', id)) AS image", "cast(name AS binary) AS gray", "cast(set_code AS binary) AS color")
    out = catalogue.carried_over(wanted, old)
    return out.select("id", "english_name", "canonical", "image", F.col("gray").cast("string").alias("gray"), F.col("color").cast("string").alias("color"))


def page_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages each search may read, in turn, after what was read in the day before."""
    searches = [r.query for r in table(spark, sf_dir, "search_queries").orderBy("pos").limit(MOST_SEARCHES + 1).collect()]
    if len(searches) > MOST_SEARCHES:
        raise ValueError(f"more than {MOST_SEARCHES} searches: their quotas depend on each other and are the driver's")
    used = store.requests_within(table(spark, sf_dir, "timelines"), "fetched_at", NOW).count()
    quotas = pages.allocated(pages.PAGES_A_RUN, max(0, pages.PAGES_A_DAY - used), len(searches), 5)
    return spark.createDataFrame(list(zip(searches, quotas)), "query string, pages bigint")


def newest_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest hundred rows of the store (a top-k report)."""
    return store.newest_first(table(spark, sf_dir, "posts"), ["hit_id"]).limit(100).select("hit_id", F.unix_millis("created_at").alias("ms"))


def image_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to images in an entry's document. Derived: a document with a link of each kind around the entry's own."""
    media = F.array(F.struct(F.lit("photo").alias("type"), F.struct(F.concat(F.lit("https://pbs.twimg.com/media/"), "id", F.lit("?format=jpg&name=small")).alias("href")).alias("item")))
    document = F.to_json(F.struct("url", F.concat(F.lit("http://example.org/"), "id").alias("thumbnail"), media.alias("media"), F.concat(F.lit("https://example.org/"), "id", F.lit(".PNG?x=1")).alias("note"), F.lit("image.jpg").alias("name")))
    return _entries(spark, sf_dir).select("page_id", F.col("pos").cast("bigint").alias("pos"), F.array_join(images.image_urls(document), " ").alias("links"))


def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as JSON lines and read again under the schema."""
    path = fresh_path(spark, "pages")
    table(spark, sf_dir, "timelines").write.json(path)
    return pages.entries(pages.read_pages(spark, path)).select("page_id", F.col("pos").cast("bigint").alias("pos"), "id", "body")


def published_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published document, taken apart again."""
    posts, cards = table(spark, sf_dir, "posts"), card_names(spark, sf_dir)
    counted = ranking.name_counts(posts, cards, NOW)
    document = files.snapshot(ranking.rankings(counted), ranking.window_totals(posts, counted, NOW), store.coverage(store.retained(posts, NOW)), NOW, cards={"count": cards.count()})
    schema = "cards struct<count: bigint>, coverage struct<storedPosts: bigint>, windows map<string, struct<hours: int, posts: bigint, totalDemand: bigint, rankings: array<struct<rank: bigint, name: string, demand: bigint, supply: bigint, ratioDisplay: string>>>>"
    read = spark.createDataFrame([(json.dumps(document, ensure_ascii=False),)], "d string").select(F.from_json("d", schema).alias("d")).select("d.*")
    each = read.select(F.col("cards.count").alias("cards"), F.col("coverage.storedPosts").alias("stored"), F.explode("windows").alias("window_key", "w"))
    return each.select("cards", "stored", "window_key", F.col("w.posts").alias("posts"), F.col("w.totalDemand").alias("total_demand"), F.explode("w.rankings").alias("r")).select("cards", "stored", "window_key", "posts", "total_demand", "r.rank", "r.name", "r.demand", "r.supply", F.col("r.ratioDisplay").alias("ratio_display"))


def streamed_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that landed as JSON, taken in as a stream of one batch: the accepted posts in the store, every copy of other searches and runs kept."""
    landed, kept, checkpoint = (fresh_path(spark, x) for x in ("landed", "store", "offsets"))
    table(spark, sf_dir, "timelines").write.json(landed)
    names, aliases = files.dictionary(table(spark, sf_dir, "cards"))
    ingest_pages(page_stream(spark, landed), kept, checkpoint, names, aliases).awaitTermination()
    return spark.read.parquet(kept).select("run_id", "query", "id", F.unix_millis("created_at").alias("ms"), joined("demand").alias("demand"), joined("supply").alias("supply"))


def delivered_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts as a stream of about three batches: each identifier comes out once, whatever batches its copies are in."""
    landed, state, out, checkpoint = (fresh_path(spark, x) for x in ("landed", "seen", "out", "offsets"))
    posts = table(spark, sf_dir, "posts").select("hit_id", "id", "collected_at")
    posts.write.option("maxRecordsPerFile", 6000).json(landed)
    files_a_batch = -(-len(spark.read.schema(posts.schema).json(landed).inputFiles()) // 3)
    stream = spark.readStream.schema(posts.schema).option("maxFilesPerTrigger", max(1, files_a_batch)).json(landed)
    ingest_once(stream, state, out, checkpoint, "id", ["collected_at"], "hit_id").awaitTermination()
    once = spark.read.parquet(out).select(number_key("id").alias("key"))
    return once.groupBy("key").agg(F.count("*").alias("copies"))


def first_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row kept of each post with the number of names it holds."""
    posts = table(spark, sf_dir, "posts")
    return first_arrivals(posts, number_key("id"), [F.col("collected_at"), F.col("hit_id")], [F.col("hit_id"), F.size(mentions()).cast("bigint").alias("names")]).select("hit_id", "names")


QUERIES = {
    f.__name__: f
    for f in (
        unnegated_bodies, trade_images, star_marks, reused_entries, recognitions, image_counts, read_sheets, image_evidence, posts_with_images, title_readings, title_votes, agreed_titles, badge_votes, shown_cells,
        card_decisions, cell_counts, fingerprint_matches, grid_layouts, run_spans, print_counts, translated_audit, audit_report, catalogue_references, page_quotas, newest_posts, image_links, json_round_trip,
        published_snapshot, streamed_posts, delivered_once, first_copies,
    )
}

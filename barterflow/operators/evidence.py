"""Evidence from text and images put together, post by post."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barterflow.operators.extract import any_sided, sheet_segments
from barterflow.operators.multiset import counts, merged, union_by_max
from barterflow.shared import materialised


def _none():
    return F.array().cast("array<string>")


def generic_images(passes: DataFrame, names: list[str], aliases: list[tuple[str, str]], usable: str | None = None) -> DataFrame:
    """url, explicit, demand, supply of each image from its readings. ``passes``: url, pass, plain (NFKC text).

    A reading counts with both sides if it has them and names something, else with its one side. Over the
    readings of an image each name keeps its largest count. ``usable``: a boolean column; an image counts only if any reading has it.
    """
    # unfolding an array of one keeps what follows above the parsing: it runs once a reading
    read = passes.withColumn("__parts", F.explode(F.array(sheet_segments("plain"))))
    taken = read.withColumn("got", F.explode(F.array(F.struct(*any_sided(F.col("__parts"), names, aliases)[:2]))))
    if usable:
        ok = passes.groupBy("url").agg(F.bool_or(usable).alias("__ok")).where("__ok").select("url")
        taken = taken.join(ok, "url", "left_semi")
    side = lambda c: F.transform(F.col(f"got.{c}"), lambda x: F.struct(F.lit(c).alias("side"), x.alias("name")))
    each = taken.select("url", "pass", F.explode(F.concat(side("demand"), side("supply"))).alias("m")).groupBy("url", "pass", "m.side", "m.name").agg(F.count("*").alias("n"))
    most = union_by_max(each, ["url", "side"])
    lists = most.groupBy("url").agg(*[F.flatten(F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct("name", "n")))), lambda x: F.array_repeat(x["name"], x["n"].cast("int")))).alias(s) for s in ("demand", "supply")])
    out = passes.select("url").distinct().join(lists.withColumn("explicit", F.lit(True)), "url", "left")
    return out.select("url", F.coalesce("explicit", F.lit(False)).alias("explicit"), *[F.coalesce(s, _none()).alias(s) for s in ("demand", "supply")])


def images_of_posts(urls: DataFrame, recognised: DataFrame, most: int = 4) -> DataFrame:
    """id, demand, supply, explicit, image_count, authoritative of each post from its first ``most`` images.

    ``urls``: id, urls array; ``recognised``: url, layout (boolean), explicit, demand, supply. Where one image has the
    known layout, only such images count; each name keeps its largest count.
    """
    each = urls.select("id", F.posexplode(F.slice(F.array_distinct("urls"), 1, most)).alias("pos", "url")).join(recognised, "url", "left")
    of = each.groupBy("id").agg(F.count("*").cast("int").alias("image_count"), F.coalesce(F.bool_or("layout"), F.lit(False)).alias("authoritative"))
    used = each.join(of, "id").where(~F.col("authoritative") | F.col("layout"))
    groups = None
    for side in ("demand", "supply"):
        part = counts(used.select(F.struct("id", "pos").alias("image"), F.col(side).alias("names")), "image", side, "names")
        groups = part if groups is None else groups.unionByName(part)
    most_of = union_by_max(groups.select("image.id", "side", "name", "n"), ["id", "side"])
    lists = most_of.groupBy("id").agg(*[F.flatten(F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct("name", "n")))), lambda x: F.array_repeat(x["name"], x["n"].cast("int")))).alias(s) for s in ("demand", "supply")])
    said = used.groupBy("id").agg(F.coalesce(F.bool_or("explicit"), F.lit(False)).alias("said"))
    out = of.join(said, "id", "left").join(lists, "id", "left")
    sides = [F.coalesce(s, _none()).alias(s) for s in ("demand", "supply")]
    out = out.select("id", *sides, "said", "image_count", "authoritative")
    return out.select("id", "demand", "supply", (F.coalesce("said", F.lit(False)) & ((F.size("demand") > 0) | (F.size("supply") > 0))).alias("explicit"), "image_count", "authoritative")


def with_images(parsed: DataFrame, images: DataFrame) -> DataFrame:
    """``parsed`` (id, demand, supply, explicit and more, from text) with the images' evidence, and parsed_from.

    An authoritative image replaces the text even if it yields nothing; else each name keeps the larger count.
    Rows that end without evidence or without names are left out.
    """
    i = images.select("id", *[F.col(c).alias(f"i_{c}") for c in ("demand", "supply", "explicit", "image_count", "authoritative")])
    both = parsed.join(i, "id", "left")
    alone = F.coalesce("i_authoritative", F.lit(False))
    image_said, text_said = F.coalesce("i_explicit", F.lit(False)), F.coalesce("explicit", F.lit(False))
    rest = [c for c in parsed.columns if c not in ("demand", "supply", "explicit")]
    sides = [F.when(alone, F.coalesce(f"i_{s}", _none())).otherwise(merged(F.col(s), F.col(f"i_{s}"))).alias(s) for s in ("demand", "supply")]
    origin = F.when(alone, "layout-image").when(text_said & image_said, "text+image").when(image_said, "image").otherwise("text")
    out = both.select(*rest, *sides, F.when(alone, image_said).otherwise(text_said | image_said).alias("explicit"), origin.alias("parsed_from"), F.coalesce("i_image_count", F.lit(0)).alias("image_count"), alone.alias("authoritative"))
    return out.where("explicit AND (size(demand) > 0 OR size(supply) > 0)")


def fresh(cache: DataFrame, now: datetime, version: int, hours: int) -> DataFrame:
    """Cached recognitions of this version that are younger than ``hours``."""
    return cache.where((F.col("cache_version") == version) & (F.col("checked_at") > F.lit(now - timedelta(hours=hours)).cast("timestamp")))


def to_recognise(urls: DataFrame, cache: DataFrame) -> DataFrame:
    """The distinct urls no cache row has."""
    return urls.select("url").where("url IS NOT NULL").distinct().join(cache.select("url"), "url", "left_anti")


def recognised(urls: DataFrame, cache: DataFrame, recognise: Callable[[DataFrame], DataFrame], now: datetime, version: int, hours: int, most_new: int | None = None) -> tuple[DataFrame, DataFrame]:
    """All known recognitions of the urls, and the cache as it is then: what is fresh is reused, the rest recognised.

    ``recognise`` maps urls to rows of the cache's columns but checked_at and cache_version. ``most_new`` is the run's
    budget of images (None: no budget); urls beyond it are simply not known yet and come in the next run. What was
    recognised is written once, so an image is read once however often the results are.
    """
    kept = fresh(cache, now, version, hours)
    todo = to_recognise(urls, kept)
    if most_new is not None:
        todo = todo.orderBy("url").limit(most_new)
    made = recognise(todo).withColumns({"checked_at": F.lit(now).cast("timestamp"), "cache_version": F.lit(version)})
    after = kept.unionByName(materialised(made.select(*kept.columns), "recognised"))
    return after.join(urls.select("url").distinct(), "url", "left_semi"), after


def image_statistics(recognised: DataFrame) -> DataFrame:
    """One row of counts over recognised images: images, layout, explicit, with_demand, with_supply, passes, failed, new_images, cache_hits, millis.

    ``failed`` needs a column error, ``new_images`` and ``cache_hits`` a column reused, ``passes`` and ``millis`` columns of
    these names; without the column the count is null. An empty table gives 0 for all that can be counted.
    """
    has = set(recognised.columns)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint") if c in has else F.lit(None).cast("bigint")
    count = lambda c, x: F.count_if(x) if c in has else F.lit(None).cast("bigint")
    return recognised.agg(
        F.count("*").alias("images"), F.count_if("layout").alias("layout"), F.count_if("explicit").alias("explicit"), F.count_if(F.size("demand") > 0).alias("with_demand"), F.count_if(F.size("supply") > 0).alias("with_supply"),
        total("passes").alias("passes"), count("error", F.expr("error IS NOT NULL")).alias("failed"), count("reused", F.expr("NOT coalesce(reused, false)")).alias("new_images"), count("reused", F.expr("coalesce(reused, false)")).alias("cache_hits"), total("millis").alias("millis"),
    )


def cell_statistics(cells: DataFrame) -> DataFrame:
    """One row of counts over the cells of known layouts: cells, images, matched, verified, rejected_rarity, strong, agreed, conflict, uncertain.

    ``cells``: url, card (null: none), verified (the badge), reason (of ``visual_decision``). A cell counts as matched
    with a card and a verified badge, as rejected with a card whose badge isn't verified.
    """
    ok, card = F.coalesce("verified", F.lit(False)), F.col("card").isNotNull()
    return cells.agg(
        F.count("*").alias("cells"), F.count_distinct("url").alias("images"), F.count_if(card & ok).alias("matched"), F.count_if(ok).alias("verified"), F.count_if(card & ~ok).alias("rejected_rarity"),
        *[F.count_if(F.col("reason") == r).alias(n) for n, r in (("strong", "image-strong"), ("agreed", "image+ocr"), ("conflict", "image-ocr-conflict"), ("uncertain", "image-not-confident"))],
    )

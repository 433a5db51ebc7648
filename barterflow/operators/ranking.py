"""Demand and supply of each name over nested windows that end now."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barterflow.functions.numeric import ratio_columns
from barterflow.operators.store import within

#: Key and hours of each window.
WINDOWS = (("24h", 24), ("48h", 48), ("168h", 168))


def tagged(names: Column | str, make: Callable[[Column], Column]) -> Column:
    """A list made into structs; a missing list is empty."""
    return F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda x: make(x))


def windows_of(at: Column, now: datetime, windows: Sequence[tuple[str, int]] = WINDOWS) -> Column:
    """The keys of the windows a time lies in: a post is read once whatever the number of windows."""
    return F.array_compact(F.array(*[F.when(within(at, now, hours), F.lit(key)) for key, hours in windows]))


def windowed(posts: DataFrame, now: datetime, windows: Sequence[tuple[str, int]] = WINDOWS) -> DataFrame:
    """A row for each post and window it lies in; outside the longest window nothing is read past the filter."""
    longest = max(hours for _, hours in windows)
    return posts.where(within(F.col("created_at"), now, longest)).withColumn("window_key", F.explode(windows_of(F.col("created_at"), now, windows)))


def name_counts(posts: DataFrame, cards: DataFrame, now: datetime, windows: Sequence[tuple[str, int]] = WINDOWS) -> DataFrame:
    """window_key, name, demand, supply of the names in ``cards`` (column name); names without a mention have no row.

    Counts are partial before the shuffle, and only then names meet the dictionary.
    """
    seen = windowed(posts, now, windows)
    wanted = tagged("demand", lambda x: F.struct(x.alias("name"), F.lit(1).alias("d")))
    offered = tagged("supply", lambda x: F.struct(x.alias("name"), F.lit(0).alias("d")))
    each = seen.select("window_key", F.explode(F.concat(wanted, offered)).alias("m"))
    counted = each.groupBy("window_key", F.col("m.name").alias("name")).agg(F.sum("m.d").alias("demand"), F.sum(1 - F.col("m.d")).alias("supply"))
    return counted.join(cards.select("name").distinct(), "name").select("window_key", "name", "demand", "supply")


def rankings(counted: DataFrame, collation: str = "ja") -> DataFrame:
    """window_key, rank, name, demand, supply, ratio, ratio_display, ratio_sort, imbalance: most wanted first, then least offered, then by name.

    Ranks have no ties. ``counted`` has a row a window and name: as many as the dictionary.
    """
    order = [F.col("demand").desc(), F.col("supply").asc(), F.collate("name", collation) if collation else F.col("name"), F.col("name")]
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("window_key").orderBy(*order)).cast("bigint"))
    return ranked.select("window_key", "rank", "name", "demand", "supply", *ratio_columns(F.col("demand"), F.col("supply")), (F.col("demand") - F.col("supply")).alias("imbalance"))


def window_totals(posts: DataFrame, counted: DataFrame, now: datetime, windows: Sequence[tuple[str, int]] = WINDOWS) -> DataFrame:
    """window_key, hours, posts (all in the window, with or without known names), total_demand, total_supply, total_ratio...; a row for each window."""
    spark = posts.sparkSession
    keys = spark.createDataFrame(list(windows), "window_key string, hours int")
    n = windowed(posts, now, windows).groupBy("window_key").agg(F.count("*").alias("posts"))
    totals = counted.groupBy("window_key").agg(F.sum("demand").alias("total_demand"), F.sum("supply").alias("total_supply"))
    out = keys.join(n, "window_key", "left").join(totals, "window_key", "left").na.fill(0, ["posts", "total_demand", "total_supply"])
    return out.select("window_key", "hours", "posts", "total_demand", "total_supply", *ratio_columns(F.col("total_demand"), F.col("total_supply"), "total_ratio"))


def visible(ranked: DataFrame, window_key: str, search: str = "", least: int = 0, collation: str = "ja") -> DataFrame:
    """One window's ranking after a search by part of the name and a least total, ranked anew."""
    q = search.strip().lower()
    rows = ranked.where((F.col("window_key") == window_key) & F.lower("name").contains(q) & (F.col("demand") + F.col("supply") >= least))
    return rankings(rows.select("window_key", "name", "demand", "supply"), collation)


def chart_scale(rows: DataFrame) -> DataFrame:
    """scale: the largest demand or supply of the rows, at least 1."""
    return rows.agg(F.greatest(F.lit(1), F.coalesce(F.max(F.greatest("demand", "supply")), F.lit(1))).alias("scale"))


def sources(posts: DataFrame, now: datetime, hours: int, card: str | None = None, search: str = "") -> DataFrame:
    """id, created_at, demand, supply (sets) of the posts behind a window, a row an id, the time of its first row.

    ``card``: posts that hold this name; else ``search``: a part of a name, if not empty. Rows need an
    id and a time. ``seq`` orders rows of an id if there, else the time does. Sets are collected by id and
    name after both are made distinct, so an id repeated many times stays small.
    """
    none = F.array().cast("array<string>")
    rows = posts.where((F.col("id") != "") & within(F.col("created_at"), now, hours))
    every = F.concat(F.coalesce("demand", none), F.coalesce("supply", none))
    if card is not None:
        rows = rows.where(F.array_contains(every, card))
    elif search.strip():
        q = search.strip().lower()
        rows = rows.where(F.exists(every, lambda x: F.coalesce(F.lower(x).contains(q), F.lit(False))))
    seq = F.col("seq") if "seq" in posts.columns else F.col("created_at")
    first = rows.groupBy("id").agg(F.min_by("created_at", seq).alias("created_at"))
    wanted = tagged("demand", lambda x: F.struct(F.lit("demand").alias("side"), x.alias("name")))
    offered = tagged("supply", lambda x: F.struct(F.lit("supply").alias("side"), x.alias("name")))
    pairs = rows.select("id", F.explode(F.concat(wanted, offered)).alias("m")).where("m.name IS NOT NULL").select("id", "m.side", "m.name").distinct()
    sets = pairs.groupBy("id").agg(*[F.sort_array(F.collect_list(F.when(F.col("side") == s, F.col("name")))).alias(s) for s in ("demand", "supply")])
    return first.join(sets, "id", "left").select("id", "created_at", F.coalesce("demand", none).alias("demand"), F.coalesce("supply", none).alias("supply"))


def newest_sources(found: DataFrame, n: int = 100) -> DataFrame:
    """A page of the sources, the newest first (a top-k, not a cap on the whole)."""
    return found.orderBy(F.col("created_at").desc(), "id").limit(n)

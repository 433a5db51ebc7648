"""Queries over posts: surplus copies (problem 3) and trailing totals (problem 4)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barterflow.functions.ids import number_key
from barterflow.operators.arrivals import first_arrivals, surplus_copies
from barterflow.operators.trailing import dense_daily, trailing_totals
from barterflow.shared import materialised

#: Parts in which p3_found hands the posts to the state.
BATCHES = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def card_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct names of the dictionary, one a row."""
    return table(spark, sf_dir, "cards").select(F.explode("cards").alias("name")).where("name IS NOT NULL").distinct()


def kept_posts(posts: DataFrame, payload: list[Column]) -> DataFrame:
    """``payload`` of the one row kept of each post, chosen as p3_found chooses it."""
    return first_arrivals(posts, number_key("id"), [F.col("collected_at"), F.col("hit_id")], payload)


def by_time(rows: DataFrame, time: str) -> list[DataFrame]:
    """The rows in about BATCHES parts of like size, each later than the one before; rows without a time come last."""
    cuts = rows.agg(F.percentile_approx(time, [i / BATCHES for i in range(1, BATCHES)], 1000)).first()[0]
    cuts = sorted(set(cuts or []))
    t, out = F.col(time), []
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        late = F.lit(True) if lo is None else t >= lo
        out.append(rows.where(late & (t < hi)) if hi is not None else rows.where(late | t.isNull()))
    return out


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = table(spark, sf_dir, "posts")
    return surplus_copies(posts, "id", ["collected_at"], "hit_id", batches=by_time(posts, "collected_at"))


def mentions(demand: str = "demand", supply: str = "supply") -> Column:
    """All names of a post, repeats included; a missing list is an empty one."""
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(demand, none), F.coalesce(supply, none))


def card_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, day, n, total, t7, a7, t30, a30 of every card and calendar day over the kept posts that have a created_at; no row without such a post."""
    posts = table(spark, sf_dir, "posts")
    kept = kept_posts(posts, [F.to_date("created_at").alias("day"), mentions().alias("names")]).where("day IS NOT NULL")
    daily = materialised(kept.select("day", F.explode_outer("names").alias("name")).groupBy("name", "day").agg(F.count("*").alias("total")), "daily")
    span = daily.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).first()
    cards = card_names(spark, sf_dir)
    if span.lo is None:  # no day, no calendar
        cards = cards.where(F.lit(False))
    dense = dense_daily(daily, cards, span.lo or date(1970, 1, 1), span.hi or date(1970, 1, 1))
    return trailing_totals(dense, (7, 30))


def p4_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return card_days(spark, sf_dir).select("name", F.date_format("day", "yyyy-MM-dd").alias("day"), "total", "t7", F.round("a7", 6).alias("a7"), "t30", F.round("a30", 6).alias("a30"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    surge = (F.col("t7") >= 20) & (F.col("t7") * 30 >= F.col("t30") * 14)
    lull = (F.col("t7") == 0) & (F.col("t30") >= 10)
    kind = F.when(surge, "surge").when(lull, "lull")
    return card_days(spark, sf_dir).where("n >= 29").select("name", F.date_format("day", "yyyy-MM-dd").alias("day"), kind.alias("kind")).where("kind IS NOT NULL")


QUERIES = {"p3_found": p3_found, "p4_found": p4_found, "p4_totals": p4_totals}

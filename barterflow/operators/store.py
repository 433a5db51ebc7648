"""The store of posts: union of batches with all copies, retention, coverage, budget of requests."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HORIZON_HOURS, AHEAD_HOURS = 192, 1


def within(at: Column, now: datetime, hours: int, ahead_hours: int = AHEAD_HOURS) -> Column:
    """From ``hours`` before ``now`` to ``ahead_hours`` after, both ends included; null for null, so that as a filter it reaches the scan."""
    return at.between(F.lit(now - timedelta(hours=hours)).cast("timestamp"), F.lit(now + timedelta(hours=ahead_hours)).cast("timestamp"))


def retained(posts: DataFrame, now: datetime, hours: int = HORIZON_HOURS) -> DataFrame:
    """Posts with an id and a time inside the horizon."""
    return posts.where((F.col("id") != "") & within(F.col("created_at"), now, hours))


def united(old: DataFrame, new: DataFrame, now: datetime, hours: int = HORIZON_HOURS) -> DataFrame:
    """Old and new posts with every copy kept, inside the horizon. Columns only one side has are null on the other."""
    return retained(old.unionByName(new, allowMissingColumns=True), now, hours)


def stored(posts: DataFrame) -> DataFrame:
    """The four columns that are kept; missing lists are empty."""
    none = F.array().cast("array<string>")
    return posts.select("id", "created_at", F.coalesce("demand", none).alias("demand"), F.coalesce("supply", none).alias("supply"))


def newest_first(posts: DataFrame, tie: list[str]) -> DataFrame:
    return posts.orderBy(F.col("created_at").desc_nulls_last(), *tie)


def coverage(posts: DataFrame) -> DataFrame:
    """oldest, newest, stored (all copies), distinct_ids, hours between oldest and newest."""
    hours = (F.unix_micros(F.max("created_at")) - F.unix_micros(F.min("created_at"))) / 3.6e9
    return posts.agg(F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"), F.count("*").alias("stored"), F.count_distinct("id").alias("distinct_ids"), hours.alias("hours"))


def requests_within(times: DataFrame, at: str, now: datetime, hours: int = 24) -> DataFrame:
    """Rows whose time (a timestamp, or text that may be no time) lies after ``now`` less ``hours``, and not after ``now``."""
    t = F.col(at) if times.schema[at].dataType.typeName().startswith("timestamp") else F.col(at).try_cast("timestamp")
    return times.where((t > F.lit(now - timedelta(hours=hours)).cast("timestamp")) & (t <= F.lit(now).cast("timestamp")))


def last_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the last by ``order``: only the order and the row itself cross the shuffle, aggregated before it."""
    row = F.struct(*[F.col(c) for c in rows.columns])
    picked = rows.groupBy(*keys).agg(F.max_by(row, F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("__row"))
    return picked.select("__row.*")


def first_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    row = F.struct(*[F.col(c) for c in rows.columns])
    picked = rows.groupBy(*keys).agg(F.min_by(row, F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("__row"))
    return picked.select("__row.*")


def top_rows(rows: DataFrame, partition: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each partition, numbered in column rank; Spark limits each task's part before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where(F.col("rank") <= n)

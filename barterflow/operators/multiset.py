"""Lists of names as multisets: counting, writing out, and union by the larger count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts(rows: DataFrame, key: str, side: str, names: str) -> DataFrame:
    """key, side, name, n: copies of each name; null names and lists leave no row."""
    return rows.select(key, F.lit(side).alias("side"), F.explode(names).alias("name")).where("name IS NOT NULL").groupBy(key, "side", "name").agg(F.count("*").alias("n"))


def union_by_max(groups: DataFrame, keys: list[str]) -> DataFrame:
    """The largest count of each name over all groups. ``groups``: keys, name, n (counted a group)."""
    return groups.groupBy(*keys, "name").agg(F.max("n").alias("n"))


def listed(counted: DataFrame, keys: list[str], to: str = "names") -> DataFrame:
    """A sorted array with n copies of each name, a row for each combination of ``keys``. A list is as long as its record's list was."""
    each = counted.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("name", "n"))).alias("p"))
    return each.select(*keys, F.flatten(F.transform("p", lambda x: F.array_repeat(x["name"], x["n"].cast("int")))).alias(to))


def merged(a: Column, b: Column) -> Column:
    """Two arrays of one row merged by the larger count of each name, in order of first occurrence; null is empty, null names are left out."""
    none = F.array().cast("array<string>")
    a, b = (F.filter(F.coalesce(x, none), lambda v: v.isNotNull()) for x in (a, b))
    times = lambda x, v: F.size(F.filter(x, lambda y: y == v))
    return F.flatten(F.transform(F.array_distinct(F.concat(a, b)), lambda v: F.array_repeat(v, F.greatest(times(a, v), times(b, v)))))

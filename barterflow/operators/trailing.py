"""Totals over trailing periods of days, by block decomposition.

Days are cut into blocks as long as the period. Inside a block run a prefix sum (from its
first day) and a suffix sum (to its last day). A trailing period that ends on day d is the
suffix sum of the day after it began in the block before, plus the prefix sum of d: two
look-ups whatever the length of the period.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dense_daily(daily: DataFrame, entities: DataFrame, first: date, last: date, entity: str = "name", total: str = "total") -> DataFrame:
    """``daily`` (entity, day, total) with a row of 0 for each entity and day from ``first`` to ``last`` without activity.

    ``n`` numbers the days from 0. Rows out are entities x days, as asked for; each entity
    unfolds its own calendar, so nothing is joined to make it.
    """
    grid = entities.select(entity).distinct().withColumn("day", F.explode(F.sequence(F.lit(first), F.lit(last))))
    grid = grid.withColumn("n", F.datediff("day", F.lit(first)))
    return grid.join(daily, [entity, "day"], "left").select(entity, "day", "n", F.coalesce(total, F.lit(0)).cast("bigint").alias(total))


def trailing_totals(dense: DataFrame, periods: Sequence[int], entity: str = "name", total: str = "total") -> DataFrame:
    """Adds t<p> (total) and a<p> (average a day of the period) of the p days that end on each day.

    ``dense`` must hold each day ``n`` of each entity once. A period that begins before the
    first day holds the days there are; a<p> still divides by p.
    """
    history = Window.partitionBy(entity).orderBy("n")
    out = dense
    for p in periods:
        block = Window.partitionBy(entity, f"__b{p}").orderBy("n")
        out = (
            out.withColumn(f"__b{p}", F.floor(F.col("n") / p))
            .withColumn(f"__pre{p}", F.sum(total).over(block.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn(f"__suf{p}", F.sum(total).over(block.rowsBetween(0, Window.unboundedFollowing)))
        )
    for p in periods:
        # on the last day of a block the prefix holds the whole period; in the first block there is nothing before
        whole = ((F.col("n") + 1) % p == 0) | (F.col("n") < p)
        before = F.when(whole, F.lit(0)).otherwise(F.lag(f"__suf{p}", p - 1).over(history))
        out = out.withColumn(f"t{p}", (F.col(f"__pre{p}") + before).cast("bigint")).withColumn(f"a{p}", F.col(f"t{p}") / p)
    return out.drop(*[f"__{x}{p}" for p in periods for x in ("b", "pre", "suf")])

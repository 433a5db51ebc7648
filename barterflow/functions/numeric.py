"""Ratios as the rankings show them, bounds, and small arithmetic of image layouts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def hundredths(x: Column) -> Column:
    """x * 100 rounded by the exact binary value of x (a tie away from zero), as bigint; x >= 0 and below 10^13.

    The rounded product alone errs where x lies just off a tie. Its upper half of the bits
    and the rest are each multiplied without error, so the sign of the distance to the tie is exact.
    """
    n = F.floor(x * 100)
    upper = x.cast("float").cast("double")
    beyond = (upper * 200 - (n * 2 + 1)) + (x - upper) * 200
    return (n + F.when(beyond >= 0, 1).otherwise(0)).cast("bigint")


def fixed2(x: Column) -> Column:
    """x with two decimals, as ``hundredths`` rounds."""
    h = hundredths(x)
    return F.concat((h / 100).cast("bigint").cast("string"), F.lit("."), F.lpad((h % 100).cast("string"), 2, "0"))


def ratio_columns(demand: Column, supply: Column, prefix: str = "ratio") -> list[Column]:
    """ratio (null for demand without supply, 0 for neither), its display, and a value to sort by."""
    d = demand.cast("double")
    ratio = F.when((demand == 0) & (supply == 0), F.lit(0.0)).when(supply > 0, d / supply)
    display = F.when((demand == 0) & (supply == 0), F.lit("0.00")).when(supply > 0, fixed2(d / supply)).otherwise(F.lit("∞"))
    order = F.when((demand == 0) & (supply == 0), F.lit(0.0)).when(supply > 0, d / supply).otherwise(d + 1e9)
    return [ratio.alias(prefix), display.alias(f"{prefix}_display"), order.alias(f"{prefix}_sort")]


def grid_rows(height: Column, col_pitch: Column, row_pitch: Column, most: int = 12) -> Column:
    """Rows of a card grid that fit a section; 0 where a measure is missing, not finite or not positive, or where not even a badge fits."""

    def bad(x: Column) -> Column:
        return x.isNull() | F.isnan(x.cast("double")) | (x <= 0) | (x.cast("double") == float("inf"))

    badge = col_pitch * 1.02
    rows = F.floor((height - badge - 1) / row_pitch) + 1
    unusable = bad(height) | bad(col_pitch) | bad(row_pitch)
    return F.when(unusable, 0).when(height < badge + 14, 0).otherwise(clamp(rows, 1, max(1, most))).cast("int")


def span_display(hours: Column) -> Column:
    """A span of time: hours below two days, else days with one decimal."""
    return F.when(hours < 48, F.concat(F.round(hours, 0).cast("int").cast("string"), F.lit("h"))).otherwise(F.concat(F.format_number(hours / 24, 1), F.lit("d")))

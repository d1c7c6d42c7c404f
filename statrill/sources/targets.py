"""Targets that vary along the axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a target table up to which it is broadcast.
SMALL = 100_000


def fiscal_year(date: str | Column, first_month: int = 10) -> Column:
    date = F.col(date) if isinstance(date, str) else date
    return F.year(date) + F.when(F.month(date) >= first_month, 1).otherwise(0)


def inline_target(year: Column, targets: dict[int, float]) -> Column:
    """A target for each listed year; null for others."""
    out = F.lit(None).cast("double")
    for when, value in targets.items():
        out = F.when(year == when, F.lit(float(value))).otherwise(out)
    return out


def _side(targets: DataFrame) -> DataFrame:
    return F.broadcast(targets) if targets.limit(SMALL + 1).count() <= SMALL else targets


def lookup_target(df: DataFrame, targets: DataFrame, on: str, value: str) -> DataFrame:
    """Adds target by equality; without a match it is null. Of several matches the greatest counts."""
    one = targets.groupBy(on).agg(F.max(value).alias("target"))
    return df.join(_side(one), on, "left")


def range_target(df: DataFrame, targets: DataFrame, axis: str, start: str, end: str, value: str) -> DataFrame:
    """Adds target of the range that holds the axis date, both ends included; the greatest where ranges overlap.

    Ranges are spread over the dates of the axis that they cover, so the join is by equality of dates."""
    day = F.to_date(axis)
    days = df.select(day.alias("day_")).where("day_ is not null").distinct()
    spread = targets.select(F.explode(F.sequence(F.to_date(start), F.to_date(end))).alias("day_"), F.col(value).alias("v_")).groupBy("day_").agg(F.max("v_").alias("target"))
    met = _side(spread.join(days, "day_", "left_semi"))
    return df.withColumn("day_", day).join(met, "day_", "left").drop("day_")

"""From a table with bound roles to numbered points of each series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import joined, number
from .roles import Roles


def _label(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    text = F.date_format(name, "yyyy-MM-dd") if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else F.col(name).cast("string")
    return F.coalesce(text, F.lit(""))


def _sort_key(df: DataFrame, roles: Roles) -> Column | None:
    """Number of a single date or number axis: a null counts as 0 (the epoch), not-a-number goes last."""
    if len(roles.axis) != 1:
        return None
    name, kind = roles.axis[0], df.schema[roles.axis[0]].dataType
    if isinstance(kind, T.DateType):
        return F.coalesce(F.unix_date(name).cast("double"), F.lit(0.0))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.coalesce(F.unix_micros(F.col(name).cast("timestamp")).cast("double"), F.lit(0.0))
    if isinstance(kind, T.NumericType):
        x = F.col(name).cast("double")
        return F.coalesce(F.when(F.isnan(x), float("inf")).otherwise(x), F.lit(0.0))
    return None


def extract(df: DataFrame, roles: Roles, max_points: int | None = None) -> DataFrame:
    """Points in order: keys, idx (from 1), category_index (row as delivered, from 0), label, value, target, sample_size,
    spread, tooltip columns. Rows without a measurement stay as gaps. Ties of the axis keep the delivered order, which is
    `ordinal`, or the order of the axis, the measurement and the other columns if there is none. max_points keeps the first
    so many of each series, as delivered. Where no value column has a role, the first one is the measurement."""
    roles = roles.over(df)
    roles.check()
    key = _sort_key(df, roles)
    if key is None and roles.ordinal is None:
        raise ValueError("a text or multi-level axis needs an ordinal column: Spark tables have no order of their own")
    within = Window.partitionBy(*(roles.keys or [F.lit(0)]))
    ties = [roles.ordinal] if roles.ordinal else [*roles.axis, *dict.fromkeys(c for c in (roles.measure, roles.target, roles.sample_size, roles.spread, *roles.tooltips) if c)]
    out = df.withColumn("category_index", (F.row_number().over(within.orderBy(*ties)) - 1).cast("long"))
    if max_points is not None:
        out = out.where(F.col("category_index") < max_points)
    order = [F.col("category_index")] if key is None else [key, F.col("category_index")]
    return out.select(
        *roles.keys, F.row_number().over(within.orderBy(*order)).alias("idx"), "category_index",
        F.concat_ws(" / ", *[_label(df, c) for c in roles.axis]).alias("label"),
        number(df, roles.measure).alias("value"), number(df, roles.target).alias("target"), number(df, roles.sample_size).alias("sample_size"), number(df, roles.spread).alias("spread"),
        *[F.col(c).alias(f"tooltip_{c}") for c in roles.tooltips],
    )


def aggregated(df: DataFrame, roles: Roles, how: str = "sum") -> DataFrame:
    """One row for each axis value of each series, with aggregated measures; partial sums are combined before the shuffle."""
    names = [c for c in (roles.measure, roles.target, roles.sample_size, roles.spread, *roles.tooltips) if c]
    return df.groupBy(*roles.keys, *roles.axis).agg(*[getattr(F, how)(c).alias(c) for c in dict.fromkeys(names)])


def completed(df: DataFrame, roles: Roles, step: str = "1 day") -> DataFrame:
    """Adds a row without measurement for each date between a series' first and last that has none."""
    axis = roles.axis[0]
    span = df.groupBy(*roles.keys).agg(F.min(axis).alias("first_"), F.max(axis).alias("last_"))
    every = span.where("first_ is not null").select(*roles.keys, F.explode(F.expr(f"sequence(first_, last_, interval {step})")).alias(axis))
    missing = joined(every, df.select(*roles.keys, axis), [*roles.keys, axis], "left_anti")
    return df.unionByName(missing, allowMissingColumns=True)

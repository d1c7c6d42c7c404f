"""Points explained: rows of a name and a value for each real point."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.rules import RULES
from .charts import CHARTS, chart_kind


def fixed(x: Column, places: int) -> Column:
    """A double with so many places, rounded by its exact value (1.005 is less than it reads, so it gives 1.00) with halves
    away from zero; zero has no sign, what is not finite has no text, and from 1e21 on it is written with an exponent.

    The fraction is exact in a double, and so is its product with a power of ten as a sum of two: the product as rounded, and
    what rounding left out, which comes from the halves of the fraction's digits."""
    size = F.abs(x)
    whole = F.when(size < 2.0**53, F.floor(size).cast("double")).otherwise(size)
    fraction, by = size - whole, 10.0**places
    product = fraction * by
    high = fraction * 134217729.0 - (fraction * 134217729.0 - fraction)
    left_out = (high * by - product) + (fraction - high) * by
    below = F.floor(product)
    digits = below + F.when((product - below.cast("double")) - 0.5 >= -left_out, 1).otherwise(0)
    upper = F.floor(whole / 2.0**32).cast("long")
    number = upper.cast("decimal(20,0)") * F.lit(2**32).cast("decimal(11,0)") + (whole - upper.cast("double") * 2.0**32).cast("decimal(20,0)")
    carried = (number + F.when(digits == 10**places, 1).otherwise(0)).cast("string")
    text = F.concat(carried, F.lit("."), F.lpad((digits % 10**places).cast("string"), places, "0")) if places else carried
    large = F.regexp_replace(F.regexp_replace(x.cast("string"), r"\.0E", "E"), "E", "e+")
    written = F.when(size >= 1e21, large).otherwise(F.concat(F.when(x < 0, "-").otherwise(""), text))
    return F.when(F.isnan(x) | (size == float("inf")), "").when(x.isNotNull(), written)


def two_places(x: Column) -> Column:
    return fixed(x, 2)


def value_texts(built: DataFrame, keys: Sequence[str] = (), kind: str = "individuals", measure: str = "Value") -> DataFrame:
    """keys, idx, name, text of each real point's plotted value, named and written as its kind of chart does: proportions as
    percentages with one place."""
    chart = CHARTS[chart_kind(kind)]
    text = F.concat(fixed(100 * F.col("value"), 1), F.lit("%")) if chart.value_format == "0.0%" else two_places(F.col("value"))
    return built.where("value is not null").select(*keys, "idx", F.lit(chart.value_label or measure).alias("name"), text.alias("text"))


def _rows(df: DataFrame, keys: Sequence[str], items: list[tuple[Column, Column, str | Column]], number: Callable[[Column], Column]) -> DataFrame:
    """items: when, name, and a text or the column of a number; one row for each that applies, numbered in order."""
    of = lambda x: (F.lit(None).cast("string"), F.col(x)) if isinstance(x, str) else (x, F.lit(None).cast("double"))
    structs = [F.when(when, F.struct(name.alias("name"), of(value)[0].alias("text"), of(value)[1].alias("number"))) for when, name, value in items]
    each = df.select(*keys, "idx", F.posexplode(F.array_compact(F.array(*structs))).alias("position", "item"))
    return each.select(*keys, "idx", "position", F.col("item.name").alias("name"), F.coalesce("item.text", number(F.col("item.number"))).alias("text"))


def explanations(built: DataFrame, keys: Sequence[str] = (), kind: str = "individuals", axis: str = "Axis", measure: str = "Value", target: str = "Target", number: Callable[[Column], Column] = two_places) -> DataFrame:
    """keys, idx, position, name, text of each real point; `number` writes numbers."""
    yes, real = F.lit(True), built.where("value is not null")
    head = [(yes, F.lit(axis), F.col("label"))]
    if kind == "cusum":
        real = real.withColumn("c_minus_", -F.col("c_minus_neg"))
        return _rows(real, keys, [*head, (yes, F.lit("CUSUM C⁺"), "value"), (F.col("c_minus_neg").isNotNull(), F.lit("CUSUM C⁻"), "c_minus_"), (yes, F.lit("Decision interval (H)"), "ucl")], number)
    items = [*head, (yes, F.lit(measure), "value"), (F.col("phase").isNotNull() & ~F.col("single_phase"), F.lit("Phase"), F.col("phase").cast("string"))]
    items += [(yes, F.lit(name), c) for name, c in (("Center (x̄)", "center"), ("UCL", "ucl"), ("LCL", "lcl"))]
    items.append((F.col("target").isNotNull(), F.lit(target), "target"))
    items += [(F.col(f"rule{i}"), F.lit(name), F.lit(short)) for i, (name, short) in RULES.items()]
    return _rows(real, keys, items, number)


def companion_explanations(built: DataFrame, keys: Sequence[str] = (), kind: str = "mr", axis: str = "Axis", number: Callable[[Column], Column] = two_places) -> DataFrame:
    """The same of each point that has a companion value."""
    title = {"mr": "Moving range", "r": "Range", "s": "Std dev"}[kind]
    center, ucl = ("MR center (MR̄)", "MR UCL") if kind == "mr" else (f"{title} center", f"{title} UCL")
    yes = F.lit(True)
    items = [(yes, F.lit(axis), F.col("label")), (yes, F.lit(title), "comp_value"), (yes, F.lit(center), "comp_center"), (yes, F.lit(ucl), "comp_ucl"), (F.col("comp_lcl") > 0, F.lit(f"{title} LCL"), "comp_lcl")]
    return _rows(built.where("comp_value is not null"), keys, items, number)

"""The ten charts: from extracted points to limits, companion, signals and rules. Everything is lazy columns over windows of
one series, so all of a chart needs one shuffle by the series' keys; a single series is one task by nature."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import D2, LEAST_PHASE, LIMITS, MR_UCL, constant, joined, limits, rounded
from ..operators.rules import ALL, with_rules
from ..operators.series import Frames, exact_mean, mean, with_changepoint, with_points
from .options import Options

#: Weight of a reading in an EWMA that is lost in rounding.
FORGOTTEN = 1e-17


@dataclass(frozen=True)
class Chart:
    """How a kind of chart is made, and what holds for it."""

    title: str
    build: Callable[[DataFrame, Sequence[str], Options], DataFrame]
    rules: frozenset[int]
    zones: bool = True
    requires: tuple[str, ...] = ()
    value_label: str | None = None
    value_format: str | None = None
    varying_limits: bool = False
    smooth_limits: bool = False


def _null(kind: str = "double") -> Column:
    return F.lit(None).cast(kind)


def _filled(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds the columns that a chart does not have as nulls (signals: false; one phase)."""
    blank = {"count": _null(), "base_value": _null(), "phase": _null("int"), "change_at": F.col("n").cast("int") + 1, "best_split": _null("int"), "best_statistic": _null(), "significant": F.lit(False), "comp_value": _null(), "comp_center": _null(), "comp_ucl": _null(), "comp_lcl": _null(), "c_minus_neg": _null(), "signal_upper": F.lit(False), "signal_lower": F.lit(False)}
    df = df.withColumns(columns)
    return df.withColumns({k: v for k, v in blank.items() if k not in df.columns})


def individuals(df: DataFrame, keys: Sequence[str], o: Options) -> DataFrame:
    f = Frames(keys)
    df = with_changepoint(with_points(df, keys), keys, o.threshold, o.least, o.detect, o.manual)
    df = df.withColumn("phase", F.when(F.col("idx") < F.col("change_at"), 1).otherwise(2))
    df = df.withColumns({"all_mean_": mean(F.col("value"), f.in_order), "all_mr_": mean(F.col("moving_range"), f.in_order), "mr_": F.when(F.col("idx") != F.col("change_at"), F.col("moving_range"))})
    own = f.phase()
    center = F.when(F.count("value").over(own) >= LEAST_PHASE, exact_mean(F.col("value"), own)).otherwise(F.col("all_mean_"))
    mr_bar = F.when(F.count("mr_").over(own) >= LEAST_PHASE, exact_mean(F.col("mr_"), own)).otherwise(F.col("all_mr_"))
    df = df.withColumns({"center_": center, "mr_bar_": mr_bar})
    df = df.withColumns(limits(F.col("center_"), F.col("mr_bar_"), F.col("mr_bar_") / D2, o.sigmas, o.floor)).drop("all_mean_", "all_mr_", "mr_", "center_", "mr_bar_")
    return _filled(df, comp_value=F.col("moving_range"), comp_center=F.col("mr_bar"), comp_ucl=MR_UCL * F.col("mr_bar"), comp_lcl=F.lit(0.0))


def _counted(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    df = df.select("*", F.count(F.lit(1)).over(Frames(keys).all).alias("n"), _null().alias("moving_range"), _null().alias("prev_value"), _null("int").alias("direction"))
    return df.withColumn("count", F.col("value"))


def _attribute(df: DataFrame, center: Column, spread: Callable[[Column], Column], o: Options) -> DataFrame:
    """Limits about a common center that are never below zero; a gap has no spread."""
    df = df.withColumn("center_", F.coalesce(center, F.lit(0.0)))
    sigma = F.when(F.col("value").isNull(), 0.0).otherwise(F.coalesce(spread(F.col("center_")), F.lit(0.0)))
    return _filled(df.withColumn("sigma_", sigma).withColumns(limits(F.col("center_"), F.lit(0.0), F.col("sigma_"), o.sigmas, True)).drop("center_", "sigma_"))


def _ratio(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, Column]:
    f = Frames(keys)
    valid = F.col("count").isNotNull() & (F.col("sample_size") > 0)
    df = _counted(df, keys).withColumn("value", F.when(valid, F.col("count") / F.col("sample_size")))
    return df, F.sum(F.when(valid, F.col("count"))).over(f.all) / F.sum(F.when(valid, F.col("sample_size"))).over(f.all)


def proportion(df: DataFrame, keys: Sequence[str], o: Options) -> DataFrame:
    df, center = _ratio(df, keys)
    return _attribute(df, center, lambda c: F.when((c > 0) & (c < 1), F.sqrt(c * (1 - c) / F.col("sample_size"))), o)


def rate(df: DataFrame, keys: Sequence[str], o: Options) -> DataFrame:
    df, center = _ratio(df, keys)
    return _attribute(df, center, lambda c: F.when(c > 0, F.sqrt(c / F.col("sample_size"))), o)


def defectives(df: DataFrame, keys: Sequence[str], o: Options) -> DataFrame:
    f = Frames(keys)
    df = _counted(df, keys).withColumn("size_", _first_size(f))
    share = lambda c: F.coalesce(c / F.col("size_"), F.lit(0.0))
    return _attribute(df, F.avg("value").over(f.all), lambda c: F.sqrt(F.greatest(F.lit(0.0), c * (1 - share(c)))), o).drop("size_")


def defects(df: DataFrame, keys: Sequence[str], o: Options) -> DataFrame:
    return _attribute(_counted(df, keys), F.avg("value").over(Frames(keys).all), lambda c: F.sqrt(F.greatest(F.lit(0.0), c)), o)


def _first_size(f: Frames) -> Column:
    """The first valid sample size by slot, gaps included."""
    whole = f.rows.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.first(F.when(F.col("sample_size") > 0, F.col("sample_size")), ignorenulls=True).over(whole)


def _subgroups(a: str, low: str, high: str) -> Callable[[DataFrame, Sequence[str], Options], DataFrame]:
    def build(df: DataFrame, keys: Sequence[str], o: Options) -> DataFrame:
        f = Frames(keys)
        df = with_points(df, keys).withColumns({"m_": rounded(_first_size(f)), "mean_": mean(F.col("value"), f.in_order), "spread_": mean(F.when(F.col("value").isNotNull(), F.col("spread")), f.in_order)})
        k = lambda name: F.coalesce(constant(name, F.col("m_")), F.lit(0.0))
        df = df.withColumns(limits(F.col("mean_"), F.lit(0.0), k(a) * F.col("spread_") / 3, o.sigmas, o.floor))
        return _filled(df, comp_value=F.col("spread"), comp_center=F.col("spread_"), comp_ucl=k(high) * F.col("spread_"), comp_lcl=k(low) * F.col("spread_")).drop("m_", "mean_", "spread_")

    return build


def _based(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raw readings move to base_value; the series' mean and sigma are taken from them."""
    f = Frames(keys)
    df = with_points(df, keys).withColumns({"x_": mean(F.col("value"), f.in_order), "s_": mean(F.col("moving_range"), f.in_order) / D2})
    return df.withColumns({"base_value": F.col("value"), "direction": _null("int")})


def ewma(df: DataFrame, keys: Sequence[str], o: Options) -> DataFrame:
    """The recursion z = w x + (1 - w) z as running sums, in blocks of readings: what lies more than a block back weighs
    less than rounding, so a reading needs its own block's sum, with weights that grow from the block's begin, and the end of
    the block before (at first, the mean)."""
    f, weight = Frames(keys), o.ewma_lambda
    df = _based(df, keys)
    if 0 < weight < 1:
        block = math.ceil(math.log(FORGOTTEN) / math.log(1 - weight))
        kept = lambda n: F.pow(F.lit(1.0 - weight), n)
        df = df.withColumn("k_", F.count("value").over(f.so_far) - 1)
        df = df.withColumns({"block_": F.floor(F.col("k_") / block), "j_": F.pmod("k_", F.lit(block))})
        within = Window.partitionBy(*(f.keys or [F.lit(0)]), "block_").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumn("own_", weight * kept(F.col("j_")) * F.sum(F.col("value") * kept(-F.col("j_"))).over(within))
        last = F.when((F.col("j_") == block - 1) & F.col("value").isNotNull(), F.col("own_"))
        before = F.coalesce(F.max(last).over(f.all.orderBy("block_").rangeBetween(-1, -1)), F.col("x_"))
        df = df.withColumn("z_", F.when(F.col("value").isNotNull(), F.col("own_") + kept(F.col("j_") + 1) * before)).drop("k_", "block_", "j_", "own_")
    else:
        df = df.withColumn("z_", weight * F.col("value") + (1 - weight) * F.col("x_"))
    k = F.greatest(F.lit(1), F.count("value").over(f.so_far))
    widening = F.sqrt(weight / (2 - weight) * (1 - F.pow(F.lit(1.0 - weight), 2 * k))) if weight != 2 else F.lit(0.0)
    df = df.withColumn("sigma_", F.coalesce(F.col("s_") * widening, F.lit(0.0)))
    df = df.withColumn("value", F.col("z_")).withColumns(limits(F.col("x_"), F.lit(0.0), F.col("sigma_"), o.sigmas, o.floor))
    return _filled(df.drop("x_", "s_", "z_", "sigma_"))


def moving_average(df: DataFrame, keys: Sequence[str], o: Options) -> DataFrame:
    last = Frames(keys).last(o.window)
    df = _based(df, keys).withColumns({"z_": F.when(F.col("value").isNotNull(), F.avg("value").over(last)), "k_": F.greatest(F.lit(1), F.count("value").over(last))})
    df = df.withColumn("value", F.col("z_")).withColumns(limits(F.col("x_"), F.lit(0.0), F.col("s_") / F.sqrt("k_"), o.sigmas, o.floor))
    return _filled(df.drop("x_", "s_", "z_", "k_"))


def cusum(df: DataFrame, keys: Sequence[str], o: Options) -> DataFrame:
    """Both arms, as running sums less their running minimum: the sum that is reset at zero, without a recursion."""
    f = Frames(keys)
    df = _based(df, keys)
    arms = {"up_": F.col("value") - (F.col("x_") + o.cusum_k * F.col("s_")), "down_": F.col("x_") - o.cusum_k * F.col("s_") - F.col("value")}
    df = df.withColumns({k: F.coalesce(F.sum(v).over(f.so_far), F.lit(0.0)) for k, v in arms.items()})
    arm = lambda k: F.when(F.col("value").isNotNull(), F.col(k) - F.least(F.lit(0.0), F.min(k).over(f.so_far)))
    df = df.withColumns({"plus_": arm("up_"), "minus_": arm("down_")})
    df = df.withColumns(limits(F.lit(0.0), F.lit(0.0), o.cusum_h * F.col("s_") / o.sigmas, o.sigmas, False))
    df = df.withColumns({"value": F.col("plus_"), "c_minus_neg": 0.0 - F.col("minus_"), "target": _null()})
    signals = {"signal_upper": F.coalesce(F.col("plus_") > F.col("ucl"), F.lit(False)), "signal_lower": F.coalesce(-F.col("minus_") < F.col("lcl"), F.lit(False))}
    return _filled(df.withColumns(signals).drop("x_", "s_", "up_", "down_", "plus_", "minus_"))


ONE_FOUR, ONE = frozenset({1, 4}), frozenset({1})
CHARTS: dict[str, Chart] = {
    "individuals": Chart("Individuals chart", individuals, ALL),
    "p": Chart("p-chart", proportion, ONE_FOUR, requires=("sample_size",), value_label="Proportion", value_format="0.0%", varying_limits=True),
    "np": Chart("np-chart", defectives, ONE_FOUR, requires=("sample_size",)),
    "c": Chart("c-chart", defects, ONE_FOUR),
    "u": Chart("u-chart", rate, ONE_FOUR, requires=("sample_size",), value_label="Defects per unit", varying_limits=True),
    "xbar-r": Chart("X̄-R chart", _subgroups("A2", "D3", "D4"), ALL, requires=("spread", "sample_size")),
    "xbar-s": Chart("X̄-s chart", _subgroups("A3", "B3", "B4"), ALL, requires=("spread", "sample_size")),
    "ewma": Chart("EWMA chart", ewma, ONE, zones=False, value_label="EWMA", varying_limits=True, smooth_limits=True),
    "ma": Chart("Moving-average chart", moving_average, ONE, zones=False, value_label="Moving average", varying_limits=True, smooth_limits=True),
    "cusum": Chart("CUSUM chart", cusum, frozenset(), zones=False, value_label="CUSUM"),
}


def chart_kind(name: str | None) -> str:
    return name if name in CHARTS else "individuals"


def numbered(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The points; a series that is not numbered from 1 without a gap fails the job, as every window relies on it."""
    over = Frames(keys).all  # of rows that are in order already, so nothing is sorted for it
    right = (F.min("idx").over(over) == 1) & (F.max("idx").over(over) == F.count(F.lit(1)).over(over))
    return points.withColumn("idx", F.when(right, F.col("idx")).otherwise(F.raise_error("points of a series must be numbered from 1 without a gap; extract() does so")))


def build(points: DataFrame, kind: str = "individuals", keys: Sequence[str] = (), options: Options = Options()) -> DataFrame:  # noqa: B008
    """One row for each point of each series: plotted value, limits, zones, phase, companion, signals and fired rules."""
    chart = CHARTS[chart_kind(kind)]
    df = numbered(with_rules(chart.build(points, keys, options), keys, options.rules & chart.rules), keys)
    outside = (F.col("comp_value") > F.col("comp_ucl")) | (F.col("comp_value") < F.col("comp_lcl"))
    return df.withColumn("comp_violation", F.coalesce(outside, F.lit(False))).withColumn("single_phase", F.col("change_at") > F.col("n"))


def segments(built: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows of one segment of constant limits: a phase of an individuals chart, else all of a series with the limits of its
    last real point (of the first slot, if there is none)."""
    phase = F.coalesce("phase", F.lit(1))
    last = F.max(F.struct(F.col("value").isNotNull().alias("real"), F.when(F.col("value").isNotNull(), F.col("idx")).otherwise(-F.col("idx")).alias("at"), *LIMITS)).alias("last")
    out = built.groupBy(*keys, phase.alias("segment")).agg(F.min("idx").alias("start_index"), F.max("idx").alias("end_index"), last)
    return out.select(*keys, "segment", "start_index", "end_index", *[F.col(f"last.{c}") for c in LIMITS])


def extent(built: DataFrame, keys: Sequence[str] = (), raw: bool = False) -> DataFrame:
    """Lowest and highest of what a chart shows (readings too, with raw), padded by 5 % of the range, or by a tenth of the
    magnitude where it is flat (by 1 at zero)."""
    shown = ["lcl", "ucl", "value", "target", "c_minus_neg", *(["base_value"] if raw else [])]
    low, high = F.least(*[F.min(c) for c in shown]), F.greatest(*[F.max(c) for c in shown])
    out = built.groupBy(*keys).agg(low.alias("low_"), high.alias("high_"))
    tenth = F.abs("high_") * 0.1
    pad = F.when(F.col("high_") > F.col("low_"), (F.col("high_") - F.col("low_")) * 0.05).otherwise(F.when(tenth == 0, 1.0).otherwise(tenth))
    return out.select(*keys, (F.col("low_") - pad).alias("low"), (F.col("high_") + pad).alias("high"))


def companion_extent(built: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """From 0 to the highest value or limit of the companion, padded by 5 %; by 1 where all is flat."""
    out = built.groupBy(*keys).agg(F.greatest(F.lit(0.0), F.max("comp_ucl"), F.max("comp_value")).alias("top_"))
    pad = F.when(F.col("top_") > 0, F.col("top_") * 0.05).otherwise(1.0)
    return out.select(*keys, F.lit(0.0).alias("low"), (F.col("top_") + pad).alias("high"))


def ticks(built: DataFrame, most: int = 8) -> DataFrame:
    """Marks the points whose label is shown on an axis."""
    step = F.greatest(F.lit(1), F.ceil(F.col("n") / most))
    return built.withColumn("is_tick", (F.col("idx") - 1) % step == 0)


def labelled(built: DataFrame, mode: str = "off") -> DataFrame:
    """The points that get a data label: off, all (real ones) or violations."""
    real = built.where("value is not null")
    return real.where("violation") if mode == "violations" else real if mode == "all" else real.limit(0)


def selected(built: DataFrame, chosen: DataFrame) -> DataFrame:
    """The points whose category_index (and keys, if there; a null is a key too) are chosen."""
    return joined(built, chosen, chosen.columns, "left_semi")

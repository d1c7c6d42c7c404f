"""Charts of long series: the same rows as `sources.extract` and `plans.charts.build` give, for series too long for a task.

Points are numbered in ranges and dealt out in blocks; a chart is one shuffle of its points, and small ones of a row for each
block. Sums are taken in another order than over a whole series, so doubles agree but for rounding.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import D2, LEAST_PHASE, MR_UCL, constant, limits, number, rounded
from ..operators import ranges as R
from ..operators.rules import with_rules
from ..operators.series import with_points
from ..sources.extract import _label, _sort_key
from ..sources.roles import Roles
from .charts import CHARTS, FORGOTTEN, _filled, _null, chart_kind
from .options import Options


def extract(df: DataFrame, roles: Roles, max_points: int | None = None, size: int = R.SIZE) -> DataFrame:
    """The points of `sources.extract`, numbered in ranges; numbers are long."""
    roles = roles.over(df)
    roles.check()
    key = _sort_key(df, roles)
    if key is None and roles.ordinal is None:
        raise ValueError("a text or multi-level axis needs an ordinal column: Spark tables have no order of their own")
    ties = [roles.ordinal] if roles.ordinal else [*roles.axis, *dict.fromkeys(c for c in (roles.measure, roles.target, roles.sample_size, roles.spread, *roles.tooltips) if c)]
    ready = df.select(
        *roles.keys, F.struct(*ties).alias("ties_"), (F.lit(0.0) if key is None else key).alias("key_"), F.concat_ws(" / ", *[_label(df, c) for c in roles.axis]).alias("label"),
        number(df, roles.measure).alias("value"), number(df, roles.target).alias("target"), number(df, roles.sample_size).alias("sample_size"), number(df, roles.spread).alias("spread"), *[F.col(c).alias(f"tooltip_{c}") for c in roles.tooltips],
    )
    out = R.numbered_rows(R.keyed(ready, roles.keys), [F.col("ties_")], "category_index", size).withColumn("category_index", F.col("category_index") - 1).drop("ties_")
    if max_points is not None:
        out = out.where(F.col("category_index") < max_points)
    if key is None:
        out = out.withColumn("idx", F.col("category_index") + 1)
    else:
        out = R.numbered_rows(out, [F.col("key_"), F.col("category_index")], "idx", size)
    rest = [c for c in out.columns if c not in (R.SERIES, "idx", "category_index", "key_")]
    return R.unkeyed(out.select(R.SERIES, "idx", "category_index", *rest), roles.keys)


def _with_points(df: DataFrame) -> DataFrame:
    return with_points(df, R.IN_BLOCK).drop("n")


def _summed(df: DataFrame, means: dict[str, Column], first_size: bool = False) -> DataFrame:
    """Adds n (points of the series), the named means, and the first valid sample size."""
    size = F.when((F.col("sample_size") > 0) & ~F.col(R.HALO), F.struct("idx", "sample_size"))
    facts = R.summary(df, n_=F.count(R.own(F.lit(1))), size_=F.min(size), **R.means(df, **means))
    facts = facts.select(*R.IN_BLOCK, F.sum("n_").over(R.every()).alias("n"), *([F.min("size_").over(R.every())["sample_size"].alias("size_")] if first_size else []), *[x.alias(k) for k, x in R.series_means(*means).items()])
    return R.told(df, facts)


def _one_phase(df: DataFrame, **columns: Column) -> DataFrame:
    return _filled(df, **{"change_at": F.col("n") + 1, "best_split": _null("long"), **columns})


def with_changepoint(df: DataFrame, threshold: float = 3.0, least: int = LEAST_PHASE, detect: bool = True, manual: float | None = None) -> DataFrame:
    """Blocks with best_split, best_statistic, significant and change_at, as of operators.series."""
    out = R.with_best_split(df, max(LEAST_PHASE, least))
    found = F.coalesce(F.col("best_t.t") >= threshold, F.lit(False))
    out = out.select("*", (-F.col("best_t.at")).alias("best_split"), F.coalesce("best_t.t", F.lit(0.0)).alias("best_statistic"), found.alias("significant")).drop("best_t")
    none = F.col("n") + 1
    if manual is not None and math.isfinite(manual):
        at = F.least(none, F.greatest(F.lit(2), rounded(F.lit(float(manual)))))
    else:
        at = F.when(F.col("significant"), F.col("best_split")).otherwise(none) if detect else none
    return out.withColumn("change_at", at.cast("long"))


def _individuals(df: DataFrame, o: Options) -> DataFrame:
    df = _summed(_with_points(df), {"all_mean_": F.col("value"), "all_mr_": F.col("moving_range")})
    df = with_changepoint(df, o.threshold, o.least, o.detect, o.manual)
    df = df.withColumn("phase", F.when(F.col("idx") < F.col("change_at"), 1).otherwise(2))
    of = {f"{name}{phase}_": F.when((F.col("phase") == phase) & (F.col("idx") != F.col("change_at") if name == "mr" else F.lit(True)), F.col(c)) for phase in (1, 2) for name, c in (("mean", "value"), ("mr", "moving_range"))}
    facts = R.summary(df, **R.means(df, **of))
    counts = [F.sum(f"{k}_n_").over(R.every()).alias(f"{k}count") for k in of]
    df = R.told(df, facts.select(*R.IN_BLOCK, *[x.alias(k) for k, x in R.series_means(*of).items()], *counts))
    own = lambda name, whole: F.coalesce(*[F.when((F.col("phase") == p) & (F.col(f"{name}{p}_count") >= LEAST_PHASE), F.col(f"{name}{p}_")) for p in (1, 2)], F.col(whole))
    df = df.withColumns({"center_": own("mean", "all_mean_"), "mr_bar_": own("mr", "all_mr_")})
    df = df.withColumns(limits(F.col("center_"), F.col("mr_bar_"), F.col("mr_bar_") / D2, o.sigmas, o.floor))
    df = df.drop("center_", "mr_bar_", "all_mean_", "all_mr_", *of, *[f"{k}count" for k in of])
    return _filled(df, comp_value=F.col("moving_range"), comp_center=F.col("mr_bar"), comp_ucl=MR_UCL * F.col("mr_bar"), comp_lcl=F.lit(0.0))


def _attribute(kind: str) -> Callable[[DataFrame, Options], DataFrame]:
    def build(df: DataFrame, o: Options) -> DataFrame:
        df = df.withColumns({"count": F.col("value"), "moving_range": _null(), "prev_value": _null(), "direction": _null("int")})
        if kind in ("p", "u"):
            valid = F.col("value").isNotNull() & (F.col("sample_size") > 0)
            df = _summed(df, {"c_": F.when(valid, F.col("value")), "s_": F.when(valid, F.col("sample_size"))})
            # of as many values each, so means are in the ratio of sums
            df = df.withColumn("center_", F.coalesce(F.try_divide("c_", "s_"), F.lit(0.0))).withColumn("value", F.when(valid, F.col("value") / F.col("sample_size")))
        else:
            df = _summed(df, {"center_": F.col("value")}, kind == "np")
        c = F.col("center_")
        spread = {
            "p": lambda: F.when((c > 0) & (c < 1), F.sqrt(c * (1 - c) / F.col("sample_size"))), "u": lambda: F.when(c > 0, F.sqrt(c / F.col("sample_size"))),
            "np": lambda: F.sqrt(F.greatest(F.lit(0.0), c * (1 - F.coalesce(c / F.col("size_"), F.lit(0.0))))), "c": lambda: F.sqrt(F.greatest(F.lit(0.0), c)),
        }[kind]()
        df = df.withColumn("sigma_", F.when(F.col("value").isNull(), 0.0).otherwise(F.coalesce(spread, F.lit(0.0))))
        return _one_phase(df.withColumns(limits(c, F.lit(0.0), F.col("sigma_"), o.sigmas, True)).drop("center_", "sigma_", "c_", "s_", "size_"))

    return build


def _subgroups(a: str, low: str, high: str) -> Callable[[DataFrame, Options], DataFrame]:
    def build(df: DataFrame, o: Options) -> DataFrame:
        df = _summed(_with_points(df), {"mean_": F.col("value"), "spread_": F.when(F.col("value").isNotNull(), F.col("spread"))}, True)
        k = lambda name: F.coalesce(constant(name, rounded(F.col("size_"))), F.lit(0.0))
        df = df.withColumns(limits(F.col("mean_"), F.lit(0.0), k(a) * F.col("spread_") / 3, o.sigmas, o.floor))
        return _one_phase(df, comp_value=F.col("spread"), comp_center=F.col("spread_"), comp_ucl=k(high) * F.col("spread_"), comp_lcl=k(low) * F.col("spread_")).drop("mean_", "spread_", "size_")

    return build


def _based(df: DataFrame) -> DataFrame:
    df = _summed(_with_points(df), {"x_": F.col("value"), "s_": F.col("moving_range") / D2})
    return df.withColumns({"base_value": F.col("value"), "direction": _null("int")})


def _ewma(df: DataFrame, o: Options, size: int) -> DataFrame:
    df, weight = _based(df), o.ewma_lambda
    if 0 < weight < 1:
        df = R.with_decayed_mean(df, "z_", weight, "x_", math.ceil(math.log(FORGOTTEN) / math.log(1 - weight)), size)
    else:
        blocks = R.summary(df, read_=F.count(R.own("value")))
        df = R.told(df, blocks.select(*R.IN_BLOCK, F.coalesce(F.sum("read_").over(R.before()), F.lit(0)).alias("past_")))
        df = df.withColumns({"z_": weight * F.col("value") + (1 - weight) * F.col("x_"), "seen_": F.col("past_") + F.count(R.own("value")).over(R.within())}).drop("past_")
    k = F.greatest(F.lit(1), F.col("seen_"))
    widening = F.sqrt(weight / (2 - weight) * (1 - F.pow(F.lit(1.0 - weight), 2 * k))) if weight != 2 else F.lit(0.0)
    df = df.withColumn("sigma_", F.coalesce(F.col("s_") * widening, F.lit(0.0))).withColumn("value", F.col("z_"))
    return _one_phase(df.withColumns(limits(F.col("x_"), F.lit(0.0), F.col("sigma_"), o.sigmas, o.floor)).drop("x_", "s_", "z_", "sigma_", "seen_"))


def _moving_average(df: DataFrame, o: Options) -> DataFrame:
    last = R.Window.partitionBy(*R.IN_BLOCK).orderBy("idx").rowsBetween(1 - o.window, 0)
    df = _based(df).withColumns({"z_": F.when(F.col("value").isNotNull(), F.avg("value").over(last)), "k_": F.greatest(F.lit(1), F.count("value").over(last))})
    df = df.withColumn("value", F.col("z_")).withColumns(limits(F.col("x_"), F.lit(0.0), F.col("s_") / F.sqrt("k_"), o.sigmas, o.floor))
    return _one_phase(df.drop("x_", "s_", "z_", "k_"))


def _cusum(df: DataFrame, o: Options) -> DataFrame:
    df = _based(df)
    df = R.with_reset_sum(df, plus_=F.col("value") - (F.col("x_") + o.cusum_k * F.col("s_")), minus_=F.col("x_") - o.cusum_k * F.col("s_") - F.col("value"))
    df = df.withColumns(limits(F.lit(0.0), F.lit(0.0), o.cusum_h * F.col("s_") / o.sigmas, o.sigmas, False))
    real = lambda x: F.when(F.col("base_value").isNotNull(), x)
    df = df.withColumns({"value": real(F.col("plus_")), "c_minus_neg": real(0.0 - F.col("minus_")), "target": _null()})
    signals = {"signal_upper": F.coalesce(F.col("value") > F.col("ucl"), F.lit(False)), "signal_lower": F.coalesce(F.col("c_minus_neg") < F.col("lcl"), F.lit(False))}
    return _one_phase(df.withColumns(signals).drop("x_", "s_", "plus_", "minus_"))


def build(points: DataFrame, kind: str = "individuals", keys: Sequence[str] = (), options: Options = Options(), size: int = R.SIZE) -> DataFrame:  # noqa: B008
    """The rows of `plans.charts.build` for numbered points, whatever the length of a series."""
    kind, o = chart_kind(kind), options
    df = R.dealt(R.keyed(points, keys), size, max(R.LOOK_BACK, o.window) if kind == "ma" else R.LOOK_BACK)
    df = df.repartition(*R.IN_BLOCK)
    made = {
        "individuals": lambda: _individuals(df, o), "xbar-r": lambda: _subgroups("A2", "D3", "D4")(df, o), "xbar-s": lambda: _subgroups("A3", "B3", "B4")(df, o),
        "ewma": lambda: _ewma(df, o, size), "ma": lambda: _moving_average(df, o), "cusum": lambda: _cusum(df, o),
    }.get(kind, lambda: _attribute(kind)(df, o))()
    out = with_rules(made, R.IN_BLOCK, o.rules & CHARTS[kind].rules).where(~F.col(R.HALO)).drop(R.HALO, R.BLOCK)
    outside = (F.col("comp_value") > F.col("comp_ucl")) | (F.col("comp_value") < F.col("comp_lcl"))
    out = out.withColumn("comp_violation", F.coalesce(outside, F.lit(False))).withColumn("single_phase", F.col("change_at") > F.col("n"))
    return R.unkeyed(out, keys)

"""Windows over a series and the point columns that every chart starts from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import LEAST_PHASE, rounded


class Frames:
    """Windows of one series: all of it, up to a row, the last n rows. All are dealt by the same keys."""

    def __init__(self, keys: Sequence[str]):
        self.keys = list(keys)
        self.all: WindowSpec = Window.partitionBy(*(self.keys or [F.lit(0)]))
        self.rows = self.all.orderBy("idx")
        self.so_far = self.rows.rowsBetween(Window.unboundedPreceding, 0)
        self.in_order = self.rows.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def last(self, n: int) -> WindowSpec:
        return self.rows.rowsBetween(1 - n, 0)

    def phase(self) -> WindowSpec:
        every = Window.partitionBy(*(self.keys or [F.lit(0)]), "phase").orderBy("idx")
        return every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def exact_mean(x: Column, over: WindowSpec) -> Column:
    """Mean of what is not null, summed in the order of the window and held between the least and the greatest, so that it
    does not hang on how rows were dealt out and equal values have exactly that mean; null of nothing."""
    return F.greatest(F.min(x).over(over), F.least(F.max(x).over(over), F.avg(x).over(over)))


def mean(x: Column, over: WindowSpec) -> Column:
    """exact_mean(); of nothing, 0."""
    return F.coalesce(exact_mean(x, over), F.lit(0.0))


def with_points(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Adds n, moving_range, prev_value and direction; all three are null at a gap and right after one."""
    f = Frames(keys)
    before = F.lag("value").over(f.rows)
    step = F.col("value") - before
    return df.select("*", F.count(F.lit(1)).over(f.all).alias("n"), F.abs(step).alias("moving_range"), F.when(F.col("value").isNotNull(), before).alias("prev_value"), F.signum(step).cast("int").alias("direction"))


def with_changepoint(df: DataFrame, keys: Sequence[str] = (), threshold: float = 3.0, least: int = LEAST_PHASE, detect: bool = True, manual: float | None = None) -> DataFrame:
    """Adds best_split, best_statistic, significant and change_at (n + 1: no change).

    Welch's t is taken at every real point that leaves `least` real points (10 at least) on either side; the earliest of
    the largest wins. Both sides are running windows, the later side in descending order, so the cost is that of two sorts.
    """
    f = Frames(keys)
    least = max(LEAST_PHASE, least)
    earlier = f.rows.rowsBetween(Window.unboundedPreceding, -1)
    later = f.all.orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, 0)
    sides = {}
    for name, over in (("b", earlier), ("a", later)):
        sides |= {f"n{name}_": F.count("value").over(over), f"m{name}_": F.avg("value").over(over), f"v{name}_": F.var_samp("value").over(over)}
    out = df.withColumns(sides)
    error = F.sqrt(F.col("vb_") / F.col("nb_") + F.col("va_") / F.col("na_"))
    fits = F.col("value").isNotNull() & (F.col("nb_") >= least) & (F.col("na_") >= least)
    t = F.when(fits, F.abs(F.col("ma_") - F.col("mb_")) / F.when(error == 0, F.lit(1e-4)).otherwise(error))
    best = F.max(F.when(t.isNotNull(), F.struct(t.alias("t"), (-F.col("idx")).alias("at")))).over(f.all)
    out = out.withColumn("best_", best).drop(*sides)
    found = F.coalesce(F.col("best_.t") >= threshold, F.lit(False))
    out = out.select("*", (-F.col("best_.at")).alias("best_split"), F.coalesce("best_.t", F.lit(0.0)).alias("best_statistic"), found.alias("significant")).drop("best_")
    if manual is not None and manual == manual and abs(manual) != float("inf"):
        at = F.least(F.col("n") + 1, F.greatest(F.lit(2), rounded(F.lit(float(manual)))))
    elif detect:
        at = F.when(F.col("significant"), F.col("best_split")).otherwise(F.col("n") + 1)
    else:
        at = F.col("n") + 1
    return out.withColumn("change_at", at.cast("int"))

"""What is drawn through a chart's points, as rows: unbroken runs, runs of equal limits, the ranges of segments."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import LIMITS
from ..operators.series import Frames
from .charts import segments


def runs(built: DataFrame, keys: Sequence[str] = (), column: str = "value") -> DataFrame:
    """keys, run (from 1), start_index, end_index, points of each longest run of slots in which a column (value, target) is not
    null: its line is drawn without a break from the first to the last."""
    rows = Frames(keys).rows
    there = built.where(F.col(column).isNotNull()).select(*keys, "idx")
    islands = there.withColumn("island_", F.col("idx") - F.row_number().over(rows))
    out = islands.groupBy(*keys, "island_").agg(F.min("idx").alias("start_index"), F.max("idx").alias("end_index"), F.count(F.lit(1)).alias("points"))
    order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("start_index")
    return out.select(*keys, F.row_number().over(order).alias("run"), "start_index", "end_index", "points")


def limit_runs(built: DataFrame, keys: Sequence[str] = (), limits: Sequence[str] = ("center", "ucl", "lcl")) -> DataFrame:
    """keys, run (from 1), start_index, end_index and the limits of each longest run of real points, one slot after the other,
    that have the same limits: one step of a limit line, which breaks at gaps."""
    rows = Frames(keys).rows
    before = lambda c: F.lag(c).over(rows)
    same: Column = reduce(Column.__and__, [F.col(c).eqNullSafe(before(c)) for c in limits], before("idx") == F.col("idx") - 1)
    marked = built.where("value is not null").withColumn("new_", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    numbered = marked.withColumn("run", F.sum("new_").over(rows).cast("int"))
    return numbered.groupBy(*keys, "run").agg(F.min("idx").alias("start_index"), F.max("idx").alias("end_index"), *[F.min_by(c, "idx").alias(c) for c in limits])


def segment_ranges(built: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, segment, start_index, end_index, left, right, phase_line, limits of each segment, comp_center, comp_ucl, comp_lcl:
    where its lines begin and end on the axis, on which slot i is at i. Neighbours meet half-way between their points, and the
    axis has half a slot to spare at both ends; the line that marks a change of phase is where the second segment begins.
    Companion limits are those of a segment's first point."""
    own = F.coalesce("phase", F.lit(1)).alias("segment")
    first = built.groupBy(*keys, own).agg(F.min_by(F.struct("comp_center", "comp_ucl", "comp_lcl"), "idx").alias("comp_"))
    both = segments(built, keys).withColumn("key_", F.struct(*keys, "segment")).join(first.select(F.struct(*keys, "segment").alias("key_"), "comp_"), "key_")
    order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("segment")
    left = F.coalesce((F.lag("end_index").over(order) + F.col("start_index")) / 2, F.col("start_index") - 0.5)
    right = F.coalesce((F.lead("start_index").over(order) + F.col("end_index")) / 2, F.col("end_index") + 0.5)
    line = F.when(F.row_number().over(order) == 2, left)
    return both.select(*keys, "segment", "start_index", "end_index", left.alias("left"), right.alias("right"), line.alias("phase_line"), *LIMITS, "comp_.*")

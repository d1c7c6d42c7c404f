"""What keeps a series from being charted, as the message that a user is told."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import joined, rounded
from ..sources.extract import extract
from ..sources.roles import BindingError, Roles
from .charts import CHARTS, build, chart_kind
from .options import Options

#: What fields are called in messages, as are the messages below.
ROLE_LABELS = {"sample_size": "Sample size", "spread": "Subgroup range or std dev"}


def check_roles(kind: str, roles: Roles) -> None:
    """Raises BindingError for the first role that a chart needs and that is not bound; no job runs."""
    roles.check()
    chart = CHARTS[chart_kind(kind)]
    for role in chart.requires:
        if getattr(roles, role) is None:
            raise BindingError(f"{chart.title} needs a {ROLE_LABELS[role]} field")


def option_message(kind: str, o: Options) -> str | None:
    if kind == "ewma" and not 0 < o.ewma_lambda <= 1:
        return "EWMA weight (λ) must be between 0 and 1"
    if kind == "ma" and not (math.isfinite(o.ma_window) and math.floor(o.ma_window + 0.5) >= 2):
        return "Moving-average window must be a whole number 2 or more"
    if kind == "cusum" and not all(math.isfinite(x) and x > 0 for x in (o.cusum_k, o.cusum_h)):
        return "CUSUM reference value k and decision interval h must be greater than 0"
    return None


def series_status(points: DataFrame, kind: str, keys: Sequence[str] = (), options: Options = Options()) -> DataFrame:  # noqa: B008
    """keys, n, n_real, status: the first message that applies to each series, null if it can be charted."""
    kind = chart_kind(kind)
    real, sized = F.col("value").isNotNull(), F.col("sample_size") > 0
    plotted = real & sized if kind in ("p", "u") else real
    size = rounded(F.col("sample_size"))
    fits = F.coalesce((size >= 2) & (size <= 25), F.lit(False))
    facts = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("n_real"), F.sum(F.when(plotted, 1).otherwise(0)).alias("plotted"),
        F.sum(F.when(real & ~fits, 1).otherwise(0)).alias("unfit"), F.min(F.when(real, size)).alias("least"), F.max(F.when(real, size)).alias("most"), F.count(F.when(real, F.col("spread"))).alias("spreads"),
    )
    status: Column = F.when(F.col("n_real") == 0, "No valid data points").when(F.col("plotted") == 0, "No valid sample sizes")
    if kind.startswith("xbar"):
        status = status.when(F.col("unfit") > 0, "Subgroup size must be a whole number from 2 to 25").when(F.col("least") != F.col("most"), "Subgroup size must be constant across subgroups").when(F.col("spreads") == 0, "No valid subgroup ranges or std devs")
    if message := option_message(kind, options):
        status = status.otherwise(message)
    return facts.select(*keys, "n", "n_real", status.alias("status"))


def chart(points: DataFrame, kind: str = "individuals", keys: Sequence[str] = (), options: Options = Options()) -> DataFrame:  # noqa: B008
    """build() with the status of each series beside its rows, so that one bad series does not keep back the others."""
    status = series_status(points, kind, keys, options).select(*keys, "status")
    built = build(points, kind, keys, options)
    return joined(built, status, keys, "left") if keys else built.crossJoin(F.broadcast(status))  # one row


def chart_table(df: DataFrame, roles: Roles, kind: str = "individuals", options: Options = Options(), max_points: int | None = None) -> DataFrame:  # noqa: B008
    """From a table to its chart: a role that the kind needs and that is not bound raises BindingError before any job runs."""
    roles = roles.over(df)
    check_roles(kind, roles)
    return chart(extract(df, roles, max_points), kind, roles.keys, options)

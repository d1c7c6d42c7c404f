"""Run rules. Each row is held against its own limits; windows run over the series and do not stop at a phase."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .series import Frames

#: Rules by id with their name and the wording that explains them.
RULES = {
    1: ("Beyond Limits", "One point beyond the control limits (±3σ)."),
    2: ("Zone A", "2 of 3 in Zone A or beyond, same side."),
    3: ("Zone B", "4 of 5 in Zone B or beyond, same side."),
    4: ("Run Above/Below", "7 in a row on one side of the center line."),
    5: ("Trend", "7 in a row steadily rising or falling."),
    6: ("Mixture", "8 in a row with none in Zone C."),
    7: ("Stratification", "15 in a row all inside Zone C."),
    8: ("Over-Control", "14 in a row alternating up and down."),
}
ALL = frozenset(RULES)


def with_rules(df: DataFrame, keys: Sequence[str] = (), enabled: Iterable[int] = ALL) -> DataFrame:
    """Adds rule1..rule8, fired_rules and violation; rules that are not enabled are false and cost nothing."""
    f, v, wanted = Frames(keys), F.col("value"), frozenset(enabled)
    count = lambda what, n: F.sum(F.when(what, 1).otherwise(0)).over(f.last(n))
    full = lambda n: F.count("value").over(f.last(n)) == n
    varies = F.col("sigma") != 0
    inside = (v >= F.col("zone_b_lower")) & (v <= F.col("zone_b_upper"))

    def zone(name: str, of: int, n: int) -> Column:
        up, down = v >= F.col(f"zone_{name}_upper"), v <= F.col(f"zone_{name}_lower")
        return varies & full(n) & (up & (count(up, n) >= of) | down & (count(down, n) >= of))

    turned = F.col("direction") == -F.lag("direction").over(f.rows)
    df = df.withColumn("turned_", turned) if 8 in wanted else df
    checks = {
        1: lambda: (v > F.col("ucl")) | (v < F.col("lcl")),
        2: lambda: zone("a", 2, 3),
        3: lambda: zone("b", 4, 5),
        4: lambda: varies & full(7) & count(v >= F.col("center"), 7).isin(0, 7),
        5: lambda: (count(F.col("direction") == 1, 6) == 6) | (count(F.col("direction") == -1, 6) == 6),
        6: lambda: full(8) & (count(inside, 8) == 0),
        7: lambda: varies & full(15) & (count(inside, 15) == 15),
        8: lambda: (count(F.col("direction") != 0, 13) == 13) & (count(F.col("turned_"), 12) == 12),
    }
    flags = {f"rule{i}": F.coalesce(v.isNotNull() & checks[i](), F.lit(False)) if i in wanted else F.lit(False) for i in RULES}
    out = df.withColumns(flags).drop("turned_")
    fired = F.array_compact(F.array(*[F.when(F.col(f"rule{i}"), F.lit(i)) for i in RULES]))
    return out.withColumn("fired_rules", fired).withColumn("violation", F.size("fired_rules") > 0)


def rule_catalogue(spark) -> DataFrame:
    return spark.createDataFrame([(i, *x) for i, x in RULES.items()], "rule_id int, name string, tooltip string")

"""Long series in ranges: numbering, and what must be carried from one range to the next, without a task for a whole series.

A series is one value of the column SERIES, a struct of its keys (nulls compare as equal within it). Numbered rows fall into
blocks of `size` numbers. A block's rows meet in a task, with a halo of the rows right before it for what looks back a few
rows; what looks back further is put together from summaries, one row for each block: totals, sums and least sums, moments,
affine maps. Windows over the summaries of a series are of as many rows as it has blocks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.shared import written

SERIES, BLOCK, HALO = "series_", "block_", "halo_"
#: Numbers of a block, and the rows that rules and moving ranges look back.
SIZE, LOOK_BACK = 1 << 20, 15
#: Ranges up to which short ones are made: a range costs the driver a sample and a task, however few rows it has.
SHORT_RANGES = 64
IN_BLOCK = (SERIES, BLOCK)


def keyed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys put together as one column that is never null."""
    return df.select(F.struct(*([F.col(k) for k in keys] or [F.lit(0).alias("all_")])).alias(SERIES), *[c for c in df.columns if c not in keys])


def unkeyed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(SERIES).getField(k).alias(k) for k in keys], *[c for c in df.columns if c != SERIES])


def ranges_of(rows: int, size: int) -> int:
    """How many ranges so many rows are dealt to: of `size` rows while these are few, then fewer and longer ones."""
    return max(1, min(-(-rows // size), SHORT_RANGES), -(-rows // max(size, SIZE)))


def numbered_rows(df: DataFrame, order: Sequence[Column], name: str, size: int = SIZE, parts: int | None = None) -> DataFrame:
    """Adds the number (from 1) of each row within its series in an order of columns, as row_number() over the series would.

    Rows are dealt to ranges of series and order, of about `size` rows (up to SIZE, where that would make more than
    SHORT_RANGES ranges), and written; each range is then counted, and the rows of a series before a range are added to the
    places within it. So what the driver is sent to draw the ranges' borders grows by a range for each SIZE rows. Rows that are equal in the order are told apart by where
    they were read, so a range never grows with them.
    """
    parts = parts or ranges_of(df.count(), size)
    by = [F.col(SERIES), *order, F.monotonically_increasing_id()]
    names = [f"by{i}_" for i in range(len(by))]
    ranged = df.select("*", *[c.alias(n) for c, n in zip(by, names, strict=True)]).repartitionByRange(parts, *names).sortWithinPartitions(*names).drop(*names)
    part = F.spark_partition_id()
    held = written(ranged.withColumns({"range_": part, "place_": F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)}))
    before = Window.partitionBy(SERIES).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    counts = held.groupBy(SERIES, "range_").agg(F.count(F.lit(1)).alias("rows_"), F.min("place_").alias("first_"))
    add = counts.select(SERIES, "range_", (F.coalesce(F.sum("rows_").over(before), F.lit(0)) - F.col("first_") + 1).alias("add_"))
    return held.join(add, [SERIES, "range_"]).withColumn(name, F.col("place_") + F.col("add_")).drop("range_", "place_", "add_")


def dealt(points: DataFrame, size: int = SIZE, look_back: int = LOOK_BACK) -> DataFrame:
    """Points (with idx from 1) in blocks: adds the block, and whether a row is in the halo of a later block than its own."""
    own = F.expr(f"(idx - 1) div {size}")
    last = F.expr(f"(idx - 1 + {look_back}) div {size}")
    return points.withColumns({"own_": own, BLOCK: F.explode(F.sequence(own, last))}).withColumn(HALO, F.col(BLOCK) > F.col("own_")).drop("own_")


def within() -> WindowSpec:
    """The rows of a block up to a row, in order."""
    return Window.partitionBy(*IN_BLOCK).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)


def own(x: Column | str) -> Column:
    """A value of a block's own rows; null in its halo."""
    return F.when(~F.col(HALO), F.col(x) if isinstance(x, str) else x)


def summary(df: DataFrame, **aggregates: Column) -> DataFrame:
    """One row for each block. Rows are dealt by series and block already, so nothing is shuffled."""
    return df.groupBy(*IN_BLOCK).agg(*[v.alias(k) for k, v in aggregates.items()])


def every() -> WindowSpec:
    """All blocks of a series."""
    return Window.partitionBy(SERIES)


def before() -> WindowSpec:
    return every().orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)


def after() -> WindowSpec:
    return every().orderBy(F.desc(BLOCK)).rowsBetween(Window.unboundedPreceding, -1)


def told(df: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows with what a summary tells of their block; the rows stay where they are."""
    return df.join(facts, list(IN_BLOCK))


def _mean(name: str) -> Column:
    mean = F.sum(f"{name}_sum_").over(every()) / F.sum(f"{name}_n_").over(every())
    return F.coalesce(F.greatest(F.min(f"{name}_low_").over(every()), F.least(F.max(f"{name}_high_").over(every()), mean)), F.lit(0.0))


def means(df: DataFrame, **of: Column) -> dict[str, Column]:
    """Aggregates of a summary from which series_means() takes the mean of each expression over the series' own rows."""
    return {k: v for name, x in of.items() for k, v in ((f"{name}_sum_", F.sum(own(x))), (f"{name}_n_", F.count(own(x))), (f"{name}_low_", F.min(own(x))), (f"{name}_high_", F.max(own(x))))}


def series_means(*names: str) -> dict[str, Column]:
    """Means of what is not null, exact where all of it is equal; of nothing, 0."""
    return {name: _mean(name) for name in names}


# Moments: count, mean, sum of squares about it, least and greatest. Where these two are equal the others are exact.
MOMENTS = ("n", "mean", "m2", "low", "high")


def _moments(x: Column, over: WindowSpec | None = None) -> dict[str, Column]:
    on = (lambda f: f.over(over)) if over is not None else (lambda f: f)
    n = on(F.count(x))
    return {"n": n, "mean": on(F.avg(x)), "m2": F.coalesce(on(F.var_samp(x)) * (n - 1), F.lit(0.0)), "low": on(F.min(x)), "high": on(F.max(x))}


def _flat(x: Mapping[str, Column]) -> dict[str, Column]:
    same = x["low"] == x["high"]
    return {**x, "mean": F.when(same, x["low"]).otherwise(x["mean"]), "m2": F.when(same, 0.0).otherwise(F.greatest(F.lit(0.0), x["m2"]))}


def merged(a: Mapping[str, Column], b: Mapping[str, Column]) -> dict[str, Column]:
    """Moments of two sets together; either may be empty (n null or 0)."""
    na, nb = (F.coalesce(x["n"], F.lit(0)) for x in (a, b))
    n, gap = na + nb, b["mean"] - a["mean"]
    mean = F.when(na == 0, b["mean"]).when(nb == 0, a["mean"]).otherwise(a["mean"] + gap * nb / n)
    m2 = F.when(na == 0, b["m2"]).when(nb == 0, a["m2"]).otherwise(a["m2"] + b["m2"] + gap * gap * na * nb / n)
    return _flat({"n": n, "mean": mean, "m2": m2, "low": F.least(a["low"], b["low"]), "high": F.greatest(a["high"], b["high"])})


def _carried(over: WindowSpec) -> dict[str, Column]:
    """Moments of the blocks of a frame, about the series' mean `about_`."""
    n = F.sum("n").over(over)
    off = F.sum(F.col("n") * (F.col("mean") - F.col("about_"))).over(over)
    square = F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("about_")) ** 2).over(over)
    return _flat({"n": n, "mean": F.col("about_") + off / n, "m2": square - off * off / n, "low": F.min("low").over(over), "high": F.max("high").over(over)})


def with_best_split(df: DataFrame, least: int) -> DataFrame:
    """Adds best_t (struct: statistic t, at = -idx) of the series: Welch's t at each real point with `least` real points on
    either side; the earliest of the largest. Both sides are the moments of the blocks before or after, merged with those of
    the block's own rows before a point, or from it on."""
    value = own("value")
    blocks = summary(df, **_moments(value)).withColumn("about_", F.sum(F.col("n") * F.col("mean")).over(every()) / F.sum("n").over(every()))
    names = {side: {m: f"{side}_{m}_" for m in MOMENTS} for side in ("before", "after", "first", "rest")}
    carried = {names[side][m]: x for side, over in (("before", before()), ("after", after())) for m, x in _carried(over).items()}
    rows = told(df, blocks.select(*IN_BLOCK, *[x.alias(k) for k, x in carried.items()]))
    by_block = Window.partitionBy(*IN_BLOCK)
    local = {"first": by_block.orderBy("idx").rowsBetween(Window.unboundedPreceding, -1), "rest": by_block.orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, 0)}
    rows = rows.withColumns({names[side][m]: x for side, over in local.items() for m, x in _moments(value, over).items()})
    side = lambda name: {m: F.col(c) for m, c in names[name].items()}
    b, a = merged(side("before"), side("first")), merged(side("rest"), side("after"))
    rows = rows.select(*IN_BLOCK, "idx", value.alias("value"), *[x[m].alias(f"{s}_{m}") for s, x in (("b", b), ("a", a)) for m in ("n", "mean", "m2")])
    error = F.sqrt(F.col("b_m2") / (F.col("b_n") - 1) / F.col("b_n") + F.col("a_m2") / (F.col("a_n") - 1) / F.col("a_n"))
    fits = F.col("value").isNotNull() & (F.col("b_n") >= least) & (F.col("a_n") >= least)
    t = F.when(fits, F.abs(F.col("a_mean") - F.col("b_mean")) / F.when(error == 0, F.lit(1e-4)).otherwise(error))
    best = summary(rows, best_=F.max(F.when(t.isNotNull(), F.struct(t.alias("t"), (-F.col("idx")).alias("at")))))
    return told(df, best.select(*IN_BLOCK, F.max("best_").over(every()).alias("best_t")))


def with_reset_sum(df: DataFrame, **steps: Column) -> DataFrame:
    """Adds, for each name, the running sum of its steps that is reset at zero (nulls hold it). A block takes in what was
    left before it: a sum and the least of its running sums tell what becomes of that, and two blocks' compose."""
    names = list(steps)
    df = df.withColumns({f"{k}_step_": own(x) for k, x in steps.items()})
    df = df.withColumns({f"{k}_sum_": F.coalesce(F.sum(f"{k}_step_").over(within()), F.lit(0.0)) for k in names})
    df = df.withColumns({f"{k}_low_": F.min(own(f"{k}_sum_")).over(within()) for k in names})
    blocks = summary(df, **{k: v for n in names for k, v in ((f"{n}_t_", F.coalesce(F.sum(f"{n}_step_"), F.lit(0.0))), (f"{n}_m_", F.min(own(f"{n}_sum_"))))})
    blocks = blocks.withColumns({f"{n}_a_": F.coalesce(F.sum(f"{n}_t_").over(before()), F.lit(0.0)) for n in names})
    left = lambda n: F.col(f"{n}_a_") - F.least(F.lit(0.0), F.min(F.col(f"{n}_a_") + F.col(f"{n}_m_")).over(before()))
    rows = told(df, blocks.select(*IN_BLOCK, *[left(n).alias(f"{n}_in_") for n in names]))
    rows = rows.withColumns({n: F.col(f"{n}_sum_") - F.least(-F.col(f"{n}_in_"), F.col(f"{n}_low_")) for n in names})
    return rows.drop(*[f"{n}_{x}_" for n in names for x in ("step", "sum", "low", "in")])


def with_decayed_mean(df: DataFrame, name: str, weight: float, start: str, forgotten: int, size: int) -> DataFrame:
    """Adds z = weight * value + (1 - weight) * z, from the column `start`, null where there is no value, and seen_ (values so
    far). A block maps what it takes in to a * z + b, and the maps of the blocks before it are composed in order, back to where
    a reading weighs less than rounding (`forgotten` values). In a block, running sums in chunks of so many values."""
    kept = lambda n: F.pow(F.lit(1.0 - weight), n)
    df = df.withColumn("v_", own("value")).withColumn("seen_", F.count("v_").over(within()))
    df = df.withColumns({"chunk_": F.floor((F.col("seen_") - 1) / forgotten), "j_": F.pmod(F.col("seen_") - 1, F.lit(forgotten))})
    chunk = Window.partitionBy(*IN_BLOCK, "chunk_").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("sum_", weight * kept(F.col("j_")) * F.sum(F.col("v_") * kept(-F.col("j_"))).over(chunk))
    full = F.when((F.col("j_") == forgotten - 1) & F.col("v_").isNotNull(), F.col("sum_"))
    previous = F.coalesce(F.max(full).over(Window.partitionBy(*IN_BLOCK).orderBy("chunk_").rangeBetween(-1, -1)), F.lit(0.0))
    df = df.withColumn("local_", F.when(F.col("v_").isNotNull(), F.col("sum_") + kept(F.col("j_") + 1) * previous))
    blocks = summary(df, read_=F.count("v_"), b_=F.max_by("local_", F.when(F.col("local_").isNotNull(), F.col("idx"))))
    total = every().orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.withColumn("until_", F.sum("read_").over(total))
    maps = F.when(F.col("read_") > 0, F.struct("until_", kept(F.col("read_")).alias("a"), F.col("b_").alias("b")))
    reach = every().orderBy("until_").rangeBetween(-(forgotten + size), -1)
    blocks = blocks.withColumn("maps_", F.sort_array(F.collect_list(maps).over(reach)))
    df = told(df, blocks.select(*IN_BLOCK, "maps_", (F.col("until_") - F.col("read_")).alias("past_")))
    taken = F.aggregate("maps_", F.col(start), lambda z, m: m["a"] * z + m["b"])
    df = df.withColumn(name, F.col("local_") + kept(F.col("seen_")) * taken).withColumn("seen_", F.col("seen_") + F.col("past_"))
    return df.drop("v_", "chunk_", "j_", "sum_", "local_", "maps_", "past_")

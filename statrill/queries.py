"""Registered queries of the process-control engine and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.columns import CONSTANTS, LIMITS
from .operators.rules import RULES, rule_catalogue
from .operators.series import with_changepoint, with_points
from .plans import charts, explain, lines, ranged, status
from .plans.options import Options
from .sources import extract as sources
from .sources import targets
from .sources.roles import Roles

#: Doubles are compared to six places. The nudge keeps halves, which means of readings with two places often are, from
#: falling to either side by the order of a sum.
PLACES, NUDGE = 6, 1.7e-8
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(*names: str) -> list[Column]:
    """Doubles to six places, without negative zero."""
    return [(F.round(F.col(n) + NUDGE, PLACES) + F.lit(0.0)).alias(n) for n in names]


def sql_rounded(*names: str) -> str:
    return ", ".join(f"round({n} + {NUDGE}, {PLACES}) + 0.0 as {n}" for n in names)


# Series: the events of each user in order of time, blank where an event is an error.
EVENTS = Roles(axis=("ts",), measure="value", keys=("user_id",), ordinal="event_id")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return df.select("event_id", "ts", "user_id", "event_type", F.when(F.col("event_type") != "error", F.col("value")).alias("value"))


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.extract(events(spark, sf_dir), EVENTS)


# Subgroups: lines of each supplier's parts by month of shipment.
LINES = Roles(axis=("month",), measure="measure", sample_size="size", spread="spread", target="target", keys=("supplier",))


def months(spark: SparkSession, sf_dir: str, what: str) -> DataFrame:
    """By supplier group and month: returned lines of all lines, or mean and spread of quantities of five."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_suppkey") % 5).alias("supplier"), F.trunc("l_shipdate", "month").alias("month"), "l_returnflag", "l_quantity")
    size = F.count(F.lit(1)).cast("double")
    each = {
        "returns": (F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).cast("double"), size, F.lit(None).cast("double")),
        "range": (F.avg("l_quantity"), F.lit(5.0), F.max("l_quantity") - F.min("l_quantity")),
        "deviation": (F.avg("l_quantity"), F.lit(5.0), F.stddev_samp("l_quantity")),
    }[what]
    out = df.groupBy("supplier", "month").agg(each[0].alias("measure"), each[1].alias("size"), each[2].alias("spread"))
    return out.withColumn("target", F.lit(None).cast("double"))


def month_points(spark: SparkSession, sf_dir: str, what: str) -> DataFrame:
    return sources.extract(months(spark, sf_dir, what), LINES)


EVENT_SQL = """
raw as (select user_id, event_id, ts, case when event_type <> 'error' then value end as value from events),
slots as (select user_id, value, cast(row_number() over (partition by user_id order by event_id) - 1 as bigint) as category_index, strftime(ts, '%Y-%m-%d') as label, ts,
  cast(null as double) as target, cast(null as double) as sample_size, cast(null as double) as spread from raw),
numbered as (select *, row_number() over (partition by user_id order by coalesce(epoch_us(ts), 0), category_index) as idx from slots),
points as (select *, count(*) over k as n, abs(value - lag(value) over w) as moving_range, case when value is not null then lag(value) over w end as prev_value, cast(sign(value - lag(value) over w) as int) as direction
  from numbered window k as (partition by user_id), w as (partition by user_id order by idx))"""


def month_sql(what: str) -> str:
    measure, size, spread = {
        "returns": ("cast(sum(case when l_returnflag = 'R' then 1 else 0 end) as double)", "cast(count(*) as double)", "cast(null as double)"),
        "range": ("avg(l_quantity)", "5.0::double", "max(l_quantity) - min(l_quantity)"),
        "deviation": ("avg(l_quantity)", "5.0::double", "stddev_samp(l_quantity)"),
    }[what]
    return f"""
months as (select l_suppkey % 5 as supplier, date_trunc('month', l_shipdate)::date as month, {measure} as value, {size} as sample_size, {spread} as spread from lineitem group by 1, 2),
points as (select *, row_number() over w as idx, count(*) over k as n, strftime(month, '%Y-%m-%d') as label, abs(value - lag(value) over w) as moving_range, cast(sign(value - lag(value) over w) as int) as direction
  from months window k as (partition by supplier), w as (partition by supplier order by month))"""


CHANGE_SQL = """
sides as (select *, count(value) over b as nb, avg(value) over b as mb, var_samp(value) over b as vb, count(value) over a as na, avg(value) over a as ma, var_samp(value) over a as va from points
  window b as (partition by user_id order by idx rows between unbounded preceding and 1 preceding), a as (partition by user_id order by idx rows between current row and unbounded following)),
tested as (select *, case when value is not null and nb >= 10 and na >= 10 then abs(ma - mb) / case when sqrt(vb / nb + va / na) = 0 then 1e-4 else sqrt(vb / nb + va / na) end end as t from sides),
best as (select user_id, max(t) as best_statistic, arg_max(idx, struct_pack(a := t, b := -idx)) filter (t is not null) as best_split from tested group by user_id),
changed as (select p.*, cast(best_split as int) as best_split, coalesce(best_statistic, 0) as best_statistic, coalesce(best_statistic >= 3, false) as significant, cast(case when best_statistic >= 3 then best_split else n + 1 end as int) as change_at
  from points p join best using (user_id))"""


def limits_sql(center: str, mr_bar: str, sigma: str, floor: bool, sigmas: float = 3.0) -> str:
    low = "greatest({}, 0.0)" if floor else "{}"
    return f"{center} as center, {mr_bar} as mr_bar, {sigma} as sigma, {center} + {sigmas} * {sigma} as ucl, {low.format(f'{center} - {sigmas} * {sigma}')} as lcl, {center} + {2 * sigmas / 3} * {sigma} as zone_a_upper, {low.format(f'{center} - {2 * sigmas / 3} * {sigma}')} as zone_a_lower, {center} + {sigmas / 3} * {sigma} as zone_b_upper, {low.format(f'{center} - {sigmas / 3} * {sigma}')} as zone_b_lower"


def rules_sql(source: str, key: str, which: tuple[int, ...]) -> str:
    """A CTE `ruled` over a CTE with limits."""
    over = lambda n: f"over (partition by {key} order by idx rows between {n - 1} preceding and current row)"
    n_of = lambda cond, n: f"sum(case when {cond} then 1 else 0 end) {over(n)}"
    full = lambda n: f"count(value) {over(n)} = {n}"
    zone = lambda z, of, n: f"sigma <> 0 and {full(n)} and ((value >= zone_{z}_upper and {n_of(f'value >= zone_{z}_upper', n)} >= {of}) or (value <= zone_{z}_lower and {n_of(f'value <= zone_{z}_lower', n)} >= {of}))"
    inside = "value >= zone_b_lower and value <= zone_b_upper"
    checks = {
        1: "value > ucl or value < lcl", 2: zone("a", 2, 3), 3: zone("b", 4, 5), 4: f"sigma <> 0 and {full(7)} and {n_of('value >= center', 7)} in (0, 7)",
        5: f"{n_of('direction = 1', 6)} = 6 or {n_of('direction = -1', 6)} = 6", 6: f"{full(8)} and {n_of(inside, 8)} = 0", 7: f"sigma <> 0 and {full(15)} and {n_of(inside, 15)} = 15",
        8: f"{n_of('direction <> 0', 13)} = 13 and {n_of('turned', 12)} = 12",
    }
    flags = ", ".join(f"coalesce(value is not null and ({checks[i]}), false) as rule{i}" if i in which else f"false as rule{i}" for i in RULES)
    fired = " || ".join(f"case when rule{i} then '{i} ' else '' end" for i in RULES)
    return f"turning as (select *, direction = -lag(direction) over (partition by {key} order by idx) as turned from {source}), flagged as (select *, {flags} from turning), ruled as (select *, trim({fired}) as fired from flagged)"


#: The charts of single series, whose phases are never flat, take plain means.
SINGLE_SQL = f"""with {EVENT_SQL}, {CHANGE_SQL},
phased as (select *, case when idx < change_at then 1 else 2 end as phase, coalesce(avg(value) over k, 0) as all_mean, coalesce(avg(moving_range) over k, 0) as all_mr from changed window k as (partition by user_id)),
own as (select *, case when count(value) over p >= 10 then avg(value) over p else all_mean end as c, case when count(case when idx <> change_at then moving_range end) over p >= 10 then avg(case when idx <> change_at then moving_range end) over p else all_mr end as m
  from phased window p as (partition by user_id, phase)),
limited as (select *, {limits_sql('c', 'm', '(m / 1.128)', True)} from own), {rules_sql('limited', 'user_id', tuple(RULES))}"""

# Rules hold values against limits exactly, so means are summed in the order of points, whatever the plan, and lie between the
# least and the greatest: limits of a flat phase are its value, and no point of it is beyond them.
_mean_sql = lambda x: f"greatest(min({x}), least(max({x}), sum({x} order by idx) / count({x})))"
INDIVIDUALS_SQL = f"""with {EVENT_SQL}, {CHANGE_SQL},
whole as (select user_id, coalesce({_mean_sql('value')}, 0) as all_mean, coalesce({_mean_sql('moving_range')}, 0) as all_mr from changed group by 1),
phased as (select *, case when idx < change_at then 1 else 2 end as phase, case when idx <> change_at then moving_range end as own_mr from changed join whole using (user_id)),
halves as (select user_id, phase, case when count(value) >= 10 then {_mean_sql('value')} end as part_mean, case when count(own_mr) >= 10 then {_mean_sql('own_mr')} end as part_mr from phased group by 1, 2),
own as (select *, coalesce(part_mean, all_mean) as c, coalesce(part_mr, all_mr) as m from phased join halves using (user_id, phase)),
limited as (select *, {limits_sql('c', 'm', '(m / 1.128)', True)} from own), {rules_sql('limited', 'user_id', tuple(RULES))}"""


def _chart_columns(*keys: str) -> list:
    fired = F.array_join(F.col("fired_rules").cast("array<string>"), " ").alias("fired")
    return [*keys, "idx", *rounded("value", *LIMITS), fired]


@query(f"with {EVENT_SQL} select user_id, idx, category_index, label, {sql_rounded('value', 'moving_range', 'prev_value')}, direction from points")
def spc_points(spark, sf_dir):
    return with_points(event_points(spark, sf_dir), ["user_id"]).select("user_id", "idx", "category_index", "label", *rounded("value", "moving_range", "prev_value"), "direction")


@query(f"with {EVENT_SQL}, {CHANGE_SQL} select distinct user_id, n, change_at, best_split, significant, {sql_rounded('best_statistic')} from changed")
def spc_changepoint(spark, sf_dir):
    df = with_changepoint(with_points(event_points(spark, sf_dir), ["user_id"]), ["user_id"])
    return df.groupBy("user_id").agg(*[F.max(c).alias(c) for c in ("n", "change_at", "best_split", "significant", "best_statistic")]).select("user_id", "n", "change_at", "best_split", "significant", *rounded("best_statistic"))


@query(f"{INDIVIDUALS_SQL} select user_id, idx, phase, {sql_rounded('value', *LIMITS)}, fired, coalesce(moving_range > 3.267 * mr_bar or moving_range < 0, false) as comp_violation from ruled")
def spc_individuals(spark, sf_dir):
    return charts.build(event_points(spark, sf_dir), "individuals", ["user_id"]).select("phase", *_chart_columns("user_id"), "comp_violation")


@query(f"{INDIVIDUALS_SQL} select user_id, phase as segment, min(idx) as start_index, max(idx) as end_index, {', '.join(f'round(arg_max({c}, case when value is not null then idx else -idx end) + {NUDGE}, 6) + 0.0 as {c}' for c in LIMITS)} from ruled group by 1, 2")
def spc_segments(spark, sf_dir):
    return charts.segments(charts.build(event_points(spark, sf_dir), "individuals", ["user_id"]), ["user_id"]).select("user_id", "segment", "start_index", "end_index", *rounded(*LIMITS))


_NAMES = " ".join(f"when {i} then '{x[0]}'" for i, x in RULES.items())


@query(f"{INDIVIDUALS_SQL} select case rule_id {_NAMES} end as name, rule_id, count(*) as n from (select unnest([cast(x as int) for x in string_split(fired, ' ')]) as rule_id from ruled where fired <> '') group by 1, 2")
def spc_rule_counts(spark, sf_dir):
    built = charts.labelled(charts.build(event_points(spark, sf_dir), "individuals", ["user_id"]), "violations")
    fired = built.select(F.explode("fired_rules").alias("rule_id"))
    return fired.groupBy("rule_id").agg(F.count("*").alias("n")).join(F.broadcast(rule_catalogue(spark)), "rule_id").select("name", "rule_id", "n")


@query(f"{INDIVIDUALS_SQL}, shown as (select user_id, min(least(lcl, ucl, coalesce(value, lcl))) as lo, max(greatest(lcl, ucl, coalesce(value, ucl))) as hi from ruled group by 1) select user_id, round(lo - pad + {NUDGE}, 6) + 0.0 as low, round(hi + pad + {NUDGE}, 6) + 0.0 as high from (select *, case when hi > lo then (hi - lo) * 0.05 when hi = 0 then 1.0 else abs(hi) * 0.1 end as pad from shown)")
def spc_extent(spark, sf_dir):
    return charts.extent(charts.build(event_points(spark, sf_dir), "individuals", ["user_id"]), ["user_id"]).select("user_id", *rounded("low", "high"))


@query(f"{INDIVIDUALS_SQL} select user_id, idx, label, (idx - 1) % greatest(1, cast(ceil(n / 8) as int)) = 0 as is_tick from ruled")
def spc_ticks(spark, sf_dir):
    return charts.ticks(with_points(event_points(spark, sf_dir), ["user_id"])).select("user_id", "idx", "label", "is_tick")


def _attribute_sql(center: str, sigma: str, ratio: bool) -> str:
    value = "case when value is not null and sample_size > 0 then value / sample_size end" if ratio else "value"
    return f"""with {month_sql('returns')}, base as (select * exclude (value, direction), value as cnt, cast(null as int) as direction, {value} as value from points),
centered as (select *, coalesce({center}, 0.0) as c, first_value(sample_size) over (partition by supplier order by idx rows between unbounded preceding and unbounded following) as size from base window k as (partition by supplier)),
limited as (select * exclude (c), {limits_sql('c', '0.0', 's', True)} from (select *, case when value is null then 0.0 else coalesce({sigma}, 0.0) end as s from centered)),
{rules_sql('limited', 'supplier', (1, 4))} select supplier, idx, {sql_rounded('value', *LIMITS)}, fired from ruled"""


def _months(kind: str, what: str):
    return lambda spark, sf_dir: charts.build(month_points(spark, sf_dir, what), kind, ["supplier"]).select(*_chart_columns("supplier"))


def _named(name: str, f, sql: str | None = None) -> None:
    f.__name__ = name
    query(sql)(f)


_named("spc_p", _months("p", "returns"), _attribute_sql("sum(cnt) over k / sum(sample_size) over k", "case when c > 0 and c < 1 then sqrt(c * (1 - c) / sample_size) end", True))
_named("spc_u", _months("u", "returns"), _attribute_sql("sum(cnt) over k / sum(sample_size) over k", "case when c > 0 then sqrt(c / sample_size) end", True))
_named("spc_np", _months("np", "returns"), _attribute_sql("avg(value) over k", "sqrt(greatest(0.0, c * (1 - c / size)))", False))
_named("spc_c", _months("c", "returns"), _attribute_sql("avg(value) over k", "sqrt(greatest(0.0, c))", False))


def _subgroup_sql(what: str, a: float, low: float, high: float) -> str:
    return f"""with {month_sql(what)}, centered as (select *, avg(value) over k as c, avg(spread) over k as sp from points window k as (partition by supplier)),
limited as (select *, {limits_sql('c', '0.0', f'({a} * sp / 3)', True)} from centered), {rules_sql('limited', 'supplier', tuple(RULES))}
select supplier, idx, {sql_rounded('value', *LIMITS)}, fired, round(sp + {NUDGE}, 6) + 0.0 as comp_center, coalesce(spread > {high} * sp or spread < {low} * sp, false) as comp_violation from ruled"""


def _subgroups(kind: str, what: str):
    return lambda spark, sf_dir: charts.build(month_points(spark, sf_dir, what), kind, ["supplier"]).select(*_chart_columns("supplier"), *rounded("comp_center"), "comp_violation")


_A2, _A3, _D3, _D4, _B3, _B4 = CONSTANTS[5]
_named("spc_xbar_r", _subgroups("xbar-r", "range"), _subgroup_sql("range", _A2, _D3, _D4))
_named("spc_xbar_s", _subgroups("xbar-s", "deviation"), _subgroup_sql("deviation", _A3, _B3, _B4))

_BASE_SQL = f"{EVENT_SQL}, base as (select * exclude (value, direction), value as raw, cast(null as int) as direction, coalesce(avg(value) over k, 0) as x, coalesce(avg(moving_range) over k, 0) / 1.128 as s from points window k as (partition by user_id))"
_TIME_SQL = f"select user_id, idx, {sql_rounded('value', *LIMITS)}, fired from ruled"


def _timed(kind: str):
    return lambda spark, sf_dir: charts.build(event_points(spark, sf_dir), kind, ["user_id"]).select(*_chart_columns("user_id"))


_named("spc_ma", _timed("ma"), f"""with {_BASE_SQL}, averaged as (select *, case when raw is not null then avg(raw) over w end as value, greatest(1, count(raw) over w) as k from base window w as (partition by user_id order by idx rows between 4 preceding and current row)),
limited as (select *, {limits_sql('x', '0.0', '(s / sqrt(k))', True)} from averaged), {rules_sql('limited', 'user_id', (1,))} {_TIME_SQL}""")
_named("spc_ewma", _timed("ewma"), f"""with recursive {_BASE_SQL}, fold as (
  select user_id, idx, case when raw is null then x else 0.2 * raw + 0.8 * x end as z, case when raw is null then 0 else 1 end as k from base where idx = 1
  union all select b.user_id, b.idx, case when raw is null then z else 0.2 * raw + 0.8 * z end, k + case when raw is null then 0 else 1 end from fold f join base b on b.user_id = f.user_id and b.idx = f.idx + 1),
averaged as (select b.*, case when raw is not null then z end as value, s * sqrt(0.2 / 1.8 * (1 - pow(0.8, 2 * greatest(1, k)))) as sz from base b join fold using (user_id, idx)),
limited as (select *, {limits_sql('x', '0.0', 'sz', True)} from averaged), {rules_sql('limited', 'user_id', (1,))} {_TIME_SQL}""")


@query(f"""with recursive {_BASE_SQL}, fold as (
  select user_id, idx, greatest(0, coalesce(raw - (x + 0.5 * s), 0)) as up, greatest(0, coalesce(x - 0.5 * s - raw, 0)) as down from base where idx = 1
  union all select b.user_id, b.idx, case when raw is null then up else greatest(0, raw - (x + 0.5 * s) + up) end, case when raw is null then down else greatest(0, x - 0.5 * s - raw + down) end from fold f join base b on b.user_id = f.user_id and b.idx = f.idx + 1)
select user_id, idx, round(case when raw is not null then up end + {NUDGE}, 6) + 0.0 as value, round(case when raw is not null then 0 - down end + {NUDGE}, 6) + 0.0 as c_minus_neg, round(5 * s + {NUDGE}, 6) + 0.0 as ucl, coalesce(raw is not null and up > 5 * s, false) as signal_upper, coalesce(raw is not null and down > 5 * s, false) as signal_lower from base join fold using (user_id, idx)""")
def spc_cusum(spark, sf_dir):
    return charts.build(event_points(spark, sf_dir), "cusum", ["user_id"]).select("user_id", "idx", *rounded("value", "c_minus_neg", "ucl"), "signal_upper", "signal_lower")


@query("""with days as (select o_orderstatus as status, cast(o_orderdate as date) as day, sum(o_totalprice) as total from orders group by 1, 2),
every as (select status, unnest(generate_series(min(day), max(day), interval 1 day))::date as day from days group by 1)
select status, cast(row_number() over (partition by status order by day) as int) as idx, strftime(day, '%Y-%m-%d') as label, round(total, 2) + 0.0 as value from every left join days using (status, day)""")
def spc_complete_axis(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderstatus").alias("status"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("total"))
    roles = Roles(axis=("day",), measure="total", keys=("status",))
    points = sources.extract(sources.completed(sources.aggregated(orders, roles), roles), roles)
    return points.select("status", "idx", "label", (F.round("value", 2) + F.lit(0.0)).alias("value"))


@query("""with d as (select o_orderkey, cast(o_orderdate as date) as day, year(o_orderdate) as y, year(o_orderdate) + case when month(o_orderdate) >= 10 then 1 else 0 end as fy from orders)
select o_orderkey, fy, case y when 1995 then 100.0::double when 1996 then 110.0::double end as inline_target, case y when 1996 then 12.5::double when 1997 then 15.0::double end as year_target,
  greatest(case when day between date '1995-01-01' and date '1996-06-30' then 1.0::double end, case when day between date '1996-03-01' and date '1997-12-31' then 2.0::double end) as range_target from d""")
def spc_targets(spark, sf_dir):
    day = F.to_date("o_orderdate")
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", day.alias("day"), F.year("o_orderdate").alias("y"))
    df = df.withColumns({"fy": targets.fiscal_year("day"), "inline_target": targets.inline_target(F.col("y"), {1995: 100.0, 1996: 110.0})})
    years = spark.createDataFrame([(1996, 12.5), (1997, 15.0)], "y int, v double")
    ranges = spark.createDataFrame([("1995-01-01", "1996-06-30", 1.0), ("1996-03-01", "1997-12-31", 2.0)], "a string, b string, v double")
    df = targets.lookup_target(df, years, "y", "v").withColumnRenamed("target", "year_target")
    return targets.range_target(df, ranges, "day", "a", "b", "v").withColumnRenamed("target", "range_target").select("o_orderkey", "fy", "inline_target", "year_target", "range_target")


@query(f"with {EVENT_SQL} select user_id, count(*) as n, count(value) as n_real, case when count(value) = 0 then 'No valid data points' end as status from points group by 1")
def spc_status(spark, sf_dir):
    return status.series_status(event_points(spark, sf_dir), "individuals", ["user_id"])


# Series with something amiss: months of each supplier group, spoilt in a way of its own.
SPOILT = {"value": "case supplier when 0 then null when 4 then case when idx % 2 = 0 then value end else value end",
    "sample_size": "case supplier when 1 then 0.0 when 2 then case when idx = 3 then 26.0 else 5.0 end when 3 then case when idx = 3 then 4.0 else 5.0 end else 5.4 end",
    "spread": "case when supplier = 4 then null else spread end"}
_FIT = "count(*) filter (value is not null and not coalesce(floor(sample_size + 0.5) between 2 and 25, false))"
_SIZES = "count(distinct case when value is not null then floor(sample_size + 0.5) end)"
_STATUS = {
    "p": "case when count(value) = 0 then 'No valid data points' when count(*) filter (value is not null and sample_size > 0) = 0 then 'No valid sample sizes' end",
    "c": "case when count(value) = 0 then 'No valid data points' end",
    "xbar-r": f"case when count(value) = 0 then 'No valid data points' when {_FIT} > 0 then 'Subgroup size must be a whole number from 2 to 25' when {_SIZES} > 1 then 'Subgroup size must be constant across subgroups' when count(case when value is not null then spread end) = 0 then 'No valid subgroup ranges or std devs' end",
    "ewma": "case when count(value) = 0 then 'No valid data points' else 'EWMA weight (λ) must be between 0 and 1' end",
    "ma": "case when count(value) = 0 then 'No valid data points' else 'Moving-average window must be a whole number 2 or more' end",
    "cusum": "case when count(value) = 0 then 'No valid data points' else 'CUSUM reference value k and decision interval h must be greater than 0' end",
}


@query(f"with {month_sql('range')}, spoilt as (select supplier, idx, {', '.join(f'{v} as {k}' for k, v in SPOILT.items())} from points) " + " union all ".join(f"select '{k}' as kind, supplier, count(*) as n, count(value) as n_real, {v} as status from spoilt group by 2" for k, v in _STATUS.items()))
def spc_messages(spark, sf_dir):
    points = month_points(spark, sf_dir, "range")
    spoilt = points.withColumns({k: F.expr(v) for k, v in SPOILT.items()})
    bad = Options(ewma_lambda=0.0, ma_window=1.4, cusum_k=0.0)
    each = [status.series_status(spoilt, kind, ["supplier"], bad).select(F.lit(kind).alias("kind"), "supplier", "n", "n_real", "status") for kind in _STATUS]
    return reduce(DataFrame.unionAll, each)


def _manual_sql(at: float, sigmas: float) -> str:
    """Individuals split by hand, with other limits that may go below zero."""
    changed = CHANGE_SQL.replace("cast(case when best_statistic >= 3 then best_split else n + 1 end as int) as change_at", f"cast(least(n + 1, greatest(2, floor({at} + 0.5))) as int) as change_at")
    return INDIVIDUALS_SQL.replace(CHANGE_SQL, changed).replace(limits_sql("c", "m", "(m / 1.128)", True), limits_sql("c", "m", "(m / 1.128)", False, sigmas))


@query(f"{_manual_sql(20.5, 2.5)} select user_id, idx, phase, {sql_rounded('value', *LIMITS)}, fired from ruled")
def spc_manual(spark, sf_dir):
    options = Options(manual=20.5, sigmas=2.5, floor=False)
    return charts.build(event_points(spark, sf_dir), "individuals", ["user_id"], options).select("phase", *_chart_columns("user_id"))


#: A series on which every rule fires: by tens of points, alternating, near the middle, rising, apart from it, and far off.
PLANTED = "cast(case floor(event_id / 20) % 8 when 0 then 4 * (event_id % 2) - 2 when 1 then 0.1 * (event_id % 3) when 2 then (event_id % 20) / 2.0 - 5.03 when 3 then case when event_id % 4 < 2 then 3 else -3 end when 4 then case when event_id % 20 = 7 then 40 else 0 end when 5 then case when event_id % 3 = 0 then 0 else 3.5 end when 6 then case when event_id % 5 = 0 then 0 else 2 end else 1 end as double)"
#: Points of a block: few enough that a task of many blocks sorts them in little memory, and so many that blocks are few.
PLANTED_SIZE = 1 << 16
_PLANTED_SQL = SINGLE_SQL.replace("case when event_type <> 'error' then value end as value from events", f"{PLANTED} as value from (select 0 as user_id, event_id, ts from events)").replace("coalesce(epoch_us(ts), 0), category_index", "category_index")


@query(f"{_PLANTED_SQL}, each as (select cast(unnest(string_split(fired, ' ')) as int) as rule_id, idx from ruled where fired <> '') select rule_id, count(*) as n, sum(idx)::bigint as places from each group by 1")
def spc_planted_rules(spark, sf_dir):
    """How often each rule fires on the planted series, and where. It is as long as the table, so it is charted in blocks."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.expr(PLANTED).alias("value"))
    built = ranged.build(ranged.extract(df, Roles(axis=("event_id",)), size=PLANTED_SIZE), "individuals", size=PLANTED_SIZE)
    return built.select(F.explode("fired_rules").alias("rule_id"), "idx").groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.sum("idx").cast("long").alias("places"))


_P_SQL = _attribute_sql("sum(cnt) over k / sum(sample_size) over k", "case when c > 0 and c < 1 then sqrt(c * (1 - c) / sample_size) end", True)


@query(f"{_P_SQL.rpartition(' select supplier, idx')[0]} select supplier, 1 as segment, min(idx) as start_index, max(idx) as end_index, {', '.join(f'round(arg_max({c}, case when value is not null then idx else -idx end) + {NUDGE}, 6) + 0.0 as {c}' for c in LIMITS)} from ruled group by 1")
def spc_one_segment(spark, sf_dir):
    """A chart without phases is one segment, with the limits of its last real point."""
    built = charts.build(month_points(spark, sf_dir, "returns"), "p", ["supplier"])
    return charts.segments(built, ["supplier"]).select("supplier", "segment", "start_index", "end_index", *rounded(*LIMITS))


@query("""with d as (select n_name, s_suppkey, s_name, s_acctbal, row_number() over (partition by n_name order by s_suppkey) - 1 as at_ from supplier join nation on s_nationkey = n_nationkey)
select n_name, cast(at_ + 1 as int) as idx, at_ as category_index, s_name || ' / ' || cast(s_suppkey as varchar) as label, s_acctbal::double as value, s_acctbal::double as tooltip_balance, s_suppkey % 3 = 0 as chosen from d where at_ < 3""")
def spc_levels(spark, sf_dir):
    """Axes of two levels in the delivered order, tooltips, the first three points of each series, and a selection."""
    suppliers, nations = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("supplier", "nation"))
    df = suppliers.join(F.broadcast(nations), suppliers["s_nationkey"] == nations["n_nationkey"]).withColumn("balance", F.col("s_acctbal").cast("double"))
    roles = Roles(axis=("s_name", "s_suppkey"), measure="balance", tooltips=("balance",), keys=("n_name",), ordinal="s_suppkey")
    points = sources.extract(df, roles, max_points=3).withColumn("key", F.element_at(F.split("label", " / "), 2).cast("int"))
    chosen = charts.selected(points, points.where("key % 3 = 0").select("n_name", "category_index")).select("n_name", "category_index", F.lit(True).alias("yes"))
    return points.join(chosen, ["n_name", "category_index"], "left").select("n_name", "idx", "category_index", "label", "value", "tooltip_balance", F.coalesce("yes", F.lit(False)).alias("chosen"))


@query(f"{INDIVIDUALS_SQL} select user_id, 0.0::double as low, round(case when top > 0 then top * 1.05 else 1.0 end + {NUDGE}, 6) + 0.0 as high from (select user_id, greatest(0.0, max(3.267 * mr_bar), coalesce(max(moving_range), 0.0)) as top from ruled group by 1)")
def spc_companion_extent(spark, sf_dir):
    return charts.companion_extent(charts.build(event_points(spark, sf_dir), "individuals", ["user_id"]), ["user_id"]).select("user_id", "low", *rounded("high"))


def to_places(built: DataFrame, *names: str) -> DataFrame:
    """A chart with doubles of six places, so that other orders of its sums print alike."""
    return built.withColumns(dict(zip(names, rounded(*names), strict=True)))


def _sql_fixed(x: str, places: int = 2) -> str:
    """Rounding by the exact value: all digits, of which the first one left out decides."""
    digits = f"printf('%.60f', abs({x}))"
    whole = f"((split_part({digits}, '.', 1) || left(split_part({digits}, '.', 2), {places}))::hugeint + case when substr(split_part({digits}, '.', 2), {places + 1}, 1) >= '5' then 1 else 0 end)"
    return f"case when {x} < 0 then '-' else '' end || ({whole} // {10**places})::varchar || '.' || lpad(({whole} % {10**places})::varchar, {places}, '0')"


def _sql_places(x: str) -> str:
    return _sql_fixed(f"(round({x} + {NUDGE}, {PLACES}) + 0.0)")


def _explained_sql(items: list[str], key: str, source: str) -> str:
    return f""", items as (select {key}, idx, [x for x in [{', '.join(items)}] if x is not null] as xs from {source}), each as (select {key}, idx, unnest(xs) as item, generate_subscripts(xs, 1) - 1 as position from items)
select {key}, idx, cast(position as int) as position, item.name as name, item.text as text from each"""


_item = lambda name, text: f"{{'name': '{name}', 'text': {text}}}"


@query(INDIVIDUALS_SQL + _explained_sql([_item("Axis", "label"), _item("Value", _sql_places("value")), f"case when change_at <= n then {_item('Phase', 'cast(phase as varchar)')} end", _item("Center (x̄)", _sql_places("center")), _item("UCL", _sql_places("ucl")), _item("LCL", _sql_places("lcl")), *(f"case when rule{i} then {_item(name, repr(text))} end" for i, (name, text) in RULES.items())], "user_id", "ruled where value is not null"))
def spc_explanations(spark, sf_dir):
    built = to_places(charts.build(event_points(spark, sf_dir), "individuals", ["user_id"]), "value", *LIMITS)
    return explain.explanations(built, ["user_id"])


@query(INDIVIDUALS_SQL + _explained_sql([_item("Axis", "label"), _item("Moving range", _sql_places("moving_range")), _item("MR center (MR̄)", _sql_places("mr_bar")), _item("MR UCL", _sql_places("3.267 * mr_bar"))], "user_id", "ruled where moving_range is not null"))
def spc_companion_explanations(spark, sf_dir):
    built = to_places(charts.build(event_points(spark, sf_dir), "individuals", ["user_id"]), "comp_value", "comp_center", "comp_ucl", "comp_lcl")
    return explain.companion_explanations(built, ["user_id"])


_ARMS_SQL = ORACLE_SQL["spc_cusum"].rpartition("select user_id, idx")[0] + ", arms as (select b.*, up, down from base b join fold using (user_id, idx) where raw is not null)"


@query(_ARMS_SQL + _explained_sql([_item("Axis", "label"), _item("CUSUM C⁺", _sql_places("up")), _item("CUSUM C⁻", _sql_fixed(f"(-(round(0 - down + {NUDGE}, {PLACES}) + 0.0))")), _item("Decision interval (H)", _sql_places("5 * s"))], "user_id", "arms"))
def spc_cusum_explanations(spark, sf_dir):
    built = to_places(charts.build(event_points(spark, sf_dir), "cusum", ["user_id"]), "value", "c_minus_neg", "ucl")
    return explain.explanations(built, ["user_id"], "cusum")


#: Readings in every form that two places round: halves that doubles hold, halves that they only come near, signs, zeros.
FORMS = {"eighth": "event_id / 8.0D", "five": "event_id * 0.005D", "five_off": "0.005D - event_id / 1000.0D", "down": "-value", "nothing": "0.0D * -value", "large": "value * 1e14D"}


@query("with x as (" + " union all ".join(f"select event_id, '{k}' as form, {v.replace('0D', '0::double').replace('5D', '5::double').replace('14D', '14::double')} as x from events" for k, v in FORMS.items()) + f") select event_id, form, {_sql_fixed('x')} as two, {_sql_fixed('x', 1)} as one from x where x is not null")
def spc_two_places(spark, sf_dir):
    """Numbers as explanations write them."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    each = df.select("event_id", F.explode(F.array(*[F.struct(F.lit(k).alias("form"), F.expr(v).alias("x")) for k, v in FORMS.items()])).alias("e")).select("event_id", "e.*").where("x is not null")
    return each.select("event_id", "form", explain.two_places(F.col("x")).alias("two"), explain.fixed(F.col("x"), 1).alias("one"))


@query(f"{_P_SQL.rpartition(' select supplier, idx')[0]} select supplier, idx, 'Proportion' as name, {_sql_fixed(f'(round(100 * (round(value + {NUDGE}, {PLACES}) + 0.0), 6) + 0.0)', 1)} || '%' as text from ruled where value is not null")
def spc_value_texts(spark, sf_dir):
    """Plotted values by the name and in the form of their kind of chart."""
    built = to_places(charts.build(month_points(spark, sf_dir, "returns"), "p", ["supplier"]), "value")
    return explain.value_texts(built, ["supplier"], "p")


# What is drawn through the points.
_RUN_SQL = """, there as (select {key}, idx, idx - row_number() over (partition by {key} order by idx) as island from {source} where {what} is not null),
islands as (select {key}, min(idx) as start_index, max(idx) as end_index, count(*) as points from there group by {key}, island)
select {key}, cast(row_number() over (partition by {key} order by start_index) as int) as run, start_index, end_index, points from islands"""


@query(f"with {EVENT_SQL}" + _RUN_SQL.format(key="user_id", source="points", what="value"))
def spc_runs(spark, sf_dir):
    """Where the data line goes without a break."""
    return lines.runs(charts.build(event_points(spark, sf_dir), "individuals", ["user_id"]), ["user_id"])


@query("with points as (select o_orderstatus, row_number() over (partition by o_orderstatus order by coalesce(epoch_us(o_orderdate), 0), o_orderkey) as idx, case when month(o_orderdate) < 4 then o_totalprice end as target from orders)" + _RUN_SQL.format(key="o_orderstatus", source="points", what="target"))
def spc_target_runs(spark, sf_dir):
    """Where the target line goes without a break: targets of the first months of each year."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("target", F.when(F.month("o_orderdate") < 4, F.col("o_totalprice")))
    points = sources.extract(orders, Roles(axis=("o_orderdate",), measure="o_totalprice", target="target", keys=("o_orderstatus",), ordinal="o_orderkey"))
    return lines.runs(points, ["o_orderstatus"], "target")


_STEP_LIMITS = [f"round({c}, 6) as {c}" for c in ("center", "ucl", "lcl")]


@query(f"""{_P_SQL.rpartition(' select supplier, idx')[0]}, marks as (select supplier, idx, {', '.join(_STEP_LIMITS)} from ruled where value is not null),
news as (select *, case when coalesce(lag(idx) over w = idx - 1 and lag(center) over w = center and lag(ucl) over w = ucl and lag(lcl) over w = lcl, false) then 0 else 1 end as new from marks window w as (partition by supplier order by idx)),
numbered as (select *, cast(sum(new) over (partition by supplier order by idx) as int) as run from news)
select supplier, run, min(idx) as start_index, max(idx) as end_index, {', '.join(f'arg_min({c}, idx) + 0.0 as {c}' for c in ('center', 'ucl', 'lcl'))} from numbered group by 1, 2""")
def spc_limit_runs(spark, sf_dir):
    """Steps of the limit lines of a chart whose limits vary."""
    built = charts.build(month_points(spark, sf_dir, "returns"), "p", ["supplier"])
    return lines.limit_runs(built.withColumns({c: F.round(c, 6) for c in ("center", "ucl", "lcl")}), ["supplier"])


@query(f"""{INDIVIDUALS_SQL}, parts as (select user_id, phase as segment, min(idx) as start_index, max(idx) as end_index, {', '.join(f'round(arg_max({c}, case when value is not null then idx else -idx end) + {NUDGE}, 6) + 0.0 as {c}' for c in LIMITS)}, round(arg_min(3.267 * mr_bar, idx) + {NUDGE}, 6) + 0.0 as comp_ucl from ruled group by 1, 2)
select *, coalesce((lag(end_index) over w + start_index) / 2.0, start_index - 0.5)::double as left, coalesce((lead(start_index) over w + end_index) / 2.0, end_index + 0.5)::double as right, (case when row_number() over w = 2 then start_index - 0.5 end)::double as phase_line from parts window w as (partition by user_id order by segment)""")
def spc_segment_ranges(spark, sf_dir):
    """From where to where the lines of each segment go, over charts of one phase and of two."""
    ranges = lines.segment_ranges(charts.build(event_points(spark, sf_dir), "individuals", ["user_id"]), ["user_id"])
    return ranges.select("user_id", "segment", "start_index", "end_index", "left", "right", "phase_line", *rounded(*LIMITS, "comp_ucl"))


@query("""with points as (select user_id, event_id, case when event_id % 7 = 0 then null else ts end as ts, value from events),
slots as (select *, row_number() over (partition by user_id order by event_id) - 1 as category_index from points)
select user_id, cast(row_number() over (partition by user_id order by coalesce(epoch_us(ts), 0), category_index) as int) as idx, category_index, coalesce(strftime(ts, '%Y-%m-%d'), '') as label from slots""")
def spc_null_axis(spark, sf_dir):
    """Points without a date sort as the epoch's."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "value", F.when(F.col("event_id") % 7 != 0, F.col("ts")).alias("ts"))
    return sources.extract(df, EVENTS).select("user_id", "idx", "category_index", "label")


@query(f"{INDIVIDUALS_SQL} select user_id, idx, phase, {sql_rounded('value', *LIMITS)}, fired from ruled")
def spc_guarded_options(spark, sf_dir):
    """An unknown kind of chart is an individuals chart, and limits of no width have the width of three sigmas."""
    return charts.build(event_points(spark, sf_dir), "pie", ["user_id"], Options(sigmas=-1.0)).select("phase", *_chart_columns("user_id"))


# One series: all events, without keys, in blocks far smaller than the series.
ONE, BLOCK_SIZE = Roles(axis=("ts",), measure="value", ordinal="event_id"), 1024
ONE_SQL = EVENT_SQL.replace("select user_id, event_id, ts,", "select 0 as user_id, event_id, ts,")


def one_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranged.extract(events(spark, sf_dir), ONE, size=BLOCK_SIZE)


def one_chart(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return ranged.build(one_series(spark, sf_dir), kind, size=BLOCK_SIZE)


@query(f"with {ONE_SQL} select idx, category_index, label, round(value, 6) + 0.0 as value from points")
def spc_range_points(spark, sf_dir):
    """A long series, numbered without a task for it."""
    return one_series(spark, sf_dir).select("idx", "category_index", "label", (F.round("value", 6) + F.lit(0.0)).alias("value"))


_ONE_INDIVIDUALS = SINGLE_SQL.replace(EVENT_SQL, ONE_SQL)


@query(f"{_ONE_INDIVIDUALS} select idx, phase, {sql_rounded('value', *LIMITS)}, fired, coalesce(moving_range > 3.267 * mr_bar or moving_range < 0, false) as comp_violation from ruled")
def spc_range_individuals(spark, sf_dir):
    return one_chart(spark, sf_dir, "individuals").select("phase", *_chart_columns(), "comp_violation")


@query(f"with {ONE_SQL}, {CHANGE_SQL} select distinct n, cast(change_at as bigint) as change_at, cast(best_split as bigint) as best_split, significant, {sql_rounded('best_statistic')} from changed")
def spc_range_changepoint(spark, sf_dir):
    df = one_chart(spark, sf_dir, "individuals")
    return df.agg(*[F.max(c).alias(c) for c in ("n", "change_at", "best_split", "significant", "best_statistic")]).select("n", "change_at", "best_split", "significant", *rounded("best_statistic"))


@query(f"{_PLANTED_SQL}, each as (select cast(unnest(string_split(fired, ' ')) as int) as rule_id, idx from ruled where fired <> '') select rule_id, count(*) as n, sum(idx)::bigint as places from each group by 1")
def spc_range_rules(spark, sf_dir):
    """Every rule on the planted series, in blocks."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.expr(PLANTED).alias("value"))
    built = ranged.build(ranged.extract(df, Roles(axis=("event_id",)), size=BLOCK_SIZE), "individuals", size=50)
    return built.select(F.explode("fired_rules").alias("rule_id"), "idx").groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.sum("idx").cast("long").alias("places"))


_ONE_BASE = _BASE_SQL.replace(EVENT_SQL, ONE_SQL)


@query(f"""with {_ONE_BASE}, reals as (select idx, raw, x, s, count(raw) over (order by idx) as k from base),
weighed as (select a.idx, sum(0.2 * pow(0.8, a.k - b.k) * b.raw) + any_value(a.x) * pow(0.8, any_value(a.k)) * case when any_value(a.k) <= 300 then 1 else 0 end as z from reals a join reals b on b.raw is not null and b.k between a.k - 300 and a.k where a.raw is not null group by 1),
averaged as (select b.*, z as value, s * sqrt(0.2 / 1.8 * (1 - pow(0.8, 2 * greatest(1, count(raw) over (order by b.idx))))) as sz from base b left join weighed w on w.idx = b.idx),
limited as (select *, {limits_sql('x', '0.0', 'sz', True)} from averaged), {rules_sql('limited', 'user_id', (1,))} select idx, {sql_rounded('value', *LIMITS)}, fired from ruled""")
def spc_range_ewma(spark, sf_dir):
    return one_chart(spark, sf_dir, "ewma").select(*_chart_columns())


@query(f"""with {_ONE_BASE}, sums as (select *, sum(raw - (x + 0.5 * s)) over w as up, sum(x - 0.5 * s - raw) over w as down from base window w as (order by idx)),
arms as (select *, up - least(0, min(up) over w) as plus, down - least(0, min(down) over w) as minus from sums window w as (order by idx))
select idx, round(case when raw is not null then plus end + {NUDGE}, 6) + 0.0 as value, round(case when raw is not null then 0 - minus end + {NUDGE}, 6) + 0.0 as c_minus_neg, round(5 * s + {NUDGE}, 6) + 0.0 as ucl, coalesce(raw is not null and plus > 5 * s, false) as signal_upper, coalesce(raw is not null and minus > 5 * s, false) as signal_lower from arms""")
def spc_range_cusum(spark, sf_dir):
    return one_chart(spark, sf_dir, "cusum").select("idx", *rounded("value", "c_minus_neg", "ucl"), "signal_upper", "signal_lower")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.chart_table(events(spark, sf_dir), EVENTS)

"""Known answers on short series, and properties that tie the window forms to the recursions they stand for."""

import decimal
import math
import random

import pytest
from pyspark.sql import functions as F

from statrill.functions.columns import CONSTANT_NAMES, constant
from statrill.operators.series import with_changepoint, with_points
from statrill.plans import charts, explain, lines
from statrill.plans.options import Options
from statrill.plans.status import chart, chart_table, check_roles, option_message, series_status
from statrill.sources import extract as sources
from statrill.sources import files, targets
from statrill.sources.roles import BindingError, Roles

SCHEMA = "k string, idx int, category_index long, label string, value double, target double, sample_size double, spread double"


def points(spark, values, n=None, spread=None, key="a"):
    at = lambda x, i: x[i] if isinstance(x, list) else x
    return spark.createDataFrame([(key, i + 1, i, str(i + 1), None if v is None else float(v), None, at(n, i), at(spread, i)) for i, v in enumerate(values)], SCHEMA)


def built(spark, values, kind="individuals", n=None, spread=None, **options):
    return charts.build(points(spark, values, n, spread), kind, ["k"], Options(**options)).orderBy("idx").collect()


def fired(rows, rule):
    return [r.idx for r in rows if rule in r.fired_rules]


def near(a, b, by=1e-3):
    return a is not None and abs(a - b) < by


def test_extraction_sorts_and_keeps_gaps(spark):
    df = spark.createDataFrame([("2023-03-01", 0.3, 30.0, "x", 0), ("2023-01-01", 0.1, 10.0, None, 1), ("2023-02-01", None, 20.0, "y", 2)], "d string, m double, t double, s string, o int").withColumn("d", F.to_date("d"))
    rows = sources.extract(df, Roles(axis=("d",), measure="m", target="s", tooltips=("t",), ordinal="o")).orderBy("idx").collect()
    assert [r.value for r in rows] == [0.1, None, 0.3] and [r.category_index for r in rows] == [1, 2, 0]
    assert [r.tooltip_t for r in rows] == [10, 20, 30] and rows[0].label == "2023-01-01" and all(r.target is None for r in rows)


def test_text_and_levels_keep_the_delivered_order(spark):
    df = spark.createDataFrame([("B", "Q1", 1.0, 0), ("A", None, 2.0, 1), ("C", "Q2", float("nan"), 2)], "a string, q string, m double, o int")
    rows = sources.extract(df, Roles(axis=("a", "q"), measure="m", ordinal="o")).orderBy("idx").collect()
    assert [r.label for r in rows] == ["B / Q1", "A / ", "C / Q2"] and rows[2].value is None
    with pytest.raises(ValueError):
        sources.extract(df, Roles(axis=("a",), measure="m"))


def test_null_numbers_of_an_axis_sort_as_zero(spark):
    df = spark.createDataFrame([(-1.0, 1.0), (None, 2.0), (float("nan"), 3.0), (1.0, 4.0)], "x double, m double")
    assert [r.value for r in sources.extract(df, Roles(axis=("x",), measure="m")).orderBy("idx").collect()] == [1, 2, 4, 3]


def test_moving_ranges(spark):
    rows = with_points(points(spark, [5, None, 7, 9]), ["k"]).orderBy("idx").collect()
    assert [r.moving_range for r in rows] == [None, None, None, 2] and [r.direction for r in rows] == [None, None, None, 1]
    means = built(spark, [10, 12, 8, None, 20, 22])
    assert near(means[0].center, 14.4, 1e-9) and near(means[0].mr_bar, 8 / 3, 1e-9)


def test_edges(spark):
    assert [(r.center, r.ucl, r.comp_violation) for r in built(spark, [5])] == [(5, 5, False)]
    flat = built(spark, [5] * 12)
    assert flat[0].sigma == 0 and flat[0].ucl == flat[0].lcl == 5 and not any(r.violation for r in flat)
    assert built(spark, [-5, -3, -8, -4, -6])[0].lcl == 0 and built(spark, [-5, -3, -8, -4, -6], floor=False)[0].lcl < 0
    assert all(r.center == r.ucl == 0 for r in built(spark, [None] * 3))
    assert built(spark, []) == []


@pytest.mark.parametrize(
    ("values", "at"),
    [([5] * 24, 25), ([1, 2, 3, 4, 5], 6), ([10] * 15 + [20] * 15, 16), ([10] * 15 + [None] + [20] * 15, 17)],
)
def test_changepoint(spark, values, at):
    assert with_changepoint(with_points(points(spark, values), ["k"]), ["k"]).first().change_at == at


@pytest.mark.parametrize(("manual", "at"), [(0, 2), (999, 31), (2.7, 3), (float("nan"), 16)])
def test_manual_changepoint(spark, manual, at):
    assert built(spark, [10] * 15 + [20] * 15, manual=manual)[0].change_at == at


def test_short_phase_takes_the_whole_series_sigma(spark):
    rows = built(spark, [10, 11] * 10 + [30, 31] * 5)
    assert rows[0].change_at == 21 and rows[-1].center == 30.5
    assert near(rows[-1].mr_bar, (28 + 19) / 29, 1e-9) and rows[0].mr_bar == 1


def test_rules(spark):
    off = {"detect": False}
    assert fired(built(spark, [1] * 5 + [2] * 7, **off), 4) == [12]
    assert fired(built(spark, [1] * 5 + [2] * 3 + [None] + [2] * 4, **off), 4) == []
    assert fired(built(spark, range(1, 9), **off), 5) == [7, 8] and fired(built(spark, [1, 2, 3, 4, 5, 6, 5.5, 7], **off), 5) == []
    assert fired(built(spark, [1, 2] * 8, **off), 8) and not fired(built(spark, [1, 2] * 4 + [2, 2] + [1, 2] * 4, **off), 8)
    assert built(spark, [*range(1, 8), None], **off)[7].fired_rules == []
    zone = fired(built(spark, [20, 20, 20, 27, 21, 27, 20, 20] + [20, 21] * 12, **off), 2)
    assert 6 in zone and 4 not in zone and 7 not in zone
    assert not any(r.fired_rules for r in built(spark, [1] * 5 + [2] * 7, rules=frozenset(), **off))


def test_attribute_charts(spark):
    c = built(spark, [2] * 4, "c")[0]
    assert near(c.center, 2) and near(c.ucl, 2 + 3 * math.sqrt(2)) and c.lcl == 0
    p = built(spark, [5, 10], "p", [100.0, 50.0])
    assert [r.value for r in p] == [0.05, 0.2] and near(p[0].center, 0.1) and near(p[0].ucl, 0.19) and near(p[1].ucl, 0.227279)
    np_ = built(spark, [2, 4, 3, 3], "np", 50.0)[0]
    assert near(np_.center, 3) and near(np_.ucl, 3 + 3 * math.sqrt(3 * 0.94))
    u = built(spark, [10, 20], "u", [5.0, 4.0])[0]
    assert near(u.center, 30 / 9) and near(u.ucl, 30 / 9 + 3 * math.sqrt(30 / 9 / 5))
    gap = built(spark, [5, 3], "p", [100.0, 0.0])
    assert gap[1].value is None and gap[1].ucl is not None and near(gap[0].center, 0.05)
    assert fired(built(spark, [15, 15, 15, 50], "p", 100.0), 1) == [4]
    assert all(r.ucl == 0 for r in built(spark, [1, 2], "p", 0.0))


def test_subgroups(spark):
    r = built(spark, [10, 12, 11, 9, 10], "xbar-r", 5.0, [4.0, 5.0, 3.0, 6.0, 4.0])[0]
    assert near(r.center, 10.4) and near(r.ucl, 10.4 + 0.577 * 4.4) and near(r.zone_a_upper, 10.4 + 2 * 0.577 * 4.4 / 3) and near(r.comp_ucl, 2.114 * 4.4) and r.comp_lcl == 0
    s = built(spark, [10, 12, 11, 9, 10], "xbar-s", 5.0, [1.0, 1.5, 0.8, 2.0, 1.2])[0]
    assert near(s.ucl, 10.4 + 1.427 * 1.3) and near(s.comp_ucl, 2.089 * 1.3)
    assert 3 in fired(built(spark, [13, 10, 13, 10, 10, 10], "xbar-r", 5.0, 4.0), 2)
    assert [x.idx for x in built(spark, [10] * 7, "xbar-r", 7.0, [5.0] * 6 + [0.1]) if x.comp_violation] == [7]
    assert all(x.ucl is not None for x in built(spark, [1, 2], "xbar-r", 99.0, 1.0))


def test_constants(spark):
    row = spark.range(1).select(*[constant(n, F.lit(m)).alias(f"c{i}") for i, (n, m) in enumerate([("A2", 5), ("D4", 5), ("D3", 7), ("B3", 7), ("A2", 1), ("A2", 26), ("A2", 5.5)])]).first()
    assert list(row) == [0.577, 2.114, 0.076, 0.118, None, None, None]


def test_ewma_and_moving_average(spark):
    z = built(spark, [10, 12, 8, 11, 9], "ewma", ewma_lambda=0.5)
    assert [r.value for r in z] == [10, 11, 9.5, 10.25, 9.625] and near(z[0].ucl, 10 + 3 * (11 / 4 / 1.128) * math.sqrt(0.5 / 1.5 * 0.75))
    assert [r.value for r in built(spark, [10, None, 12, 11], "ewma", ewma_lambda=0.5)][1:] == [None, 11.25, 11.125]
    ma = built(spark, [10, 12, 8, 11, 9], "ma", ma_window=3)
    sigma = 11 / 4 / 1.128
    assert near(ma[3].value, 10.3333) and near(ma[4].value, 9.3333) and near(ma[0].ucl, 10 + 3 * sigma) and near(ma[2].ucl, 10 + 3 * sigma / math.sqrt(3))


@pytest.mark.parametrize("weight", [0.01, 0.2, 0.9, 1.0])
def test_ewma_is_the_recursion(spark, weight):
    rng = random.Random(3)
    values = [None, None] + [None if rng.random() < 0.1 else rng.gauss(10, 2) for _ in range(700)]
    real = [v for v in values if v is not None]
    z, want = sum(real) / len(real), []
    for v in values:
        z = z if v is None else weight * v + (1 - weight) * z
        want.append(None if v is None else z)
    got = [r.value for r in built(spark, values, "ewma", ewma_lambda=weight)]
    assert all((a is None) == (b is None) and (a is None or near(a, b, 1e-9)) for a, b in zip(got, want, strict=True))


def test_cusum_is_the_recursion(spark):
    rng = random.Random(4)
    values = [None if rng.random() < 0.1 else rng.gauss(10 + (i > 40), 1) for i in range(80)]
    rows = built(spark, values, "cusum")
    real = [v for v in values if v is not None]
    steps = [abs(b - a) for a, b in zip(values, values[1:], strict=False) if a is not None and b is not None]
    x, sigma, up, down = sum(real) / len(real), sum(steps) / len(steps) / 1.128, 0.0, 0.0
    for r, v in zip(rows, values, strict=True):
        assert near(r.ucl, 5 * sigma, 1e-9) and near(r.lcl, -5 * sigma, 1e-9)
        if v is None:
            assert r.value is None and r.c_minus_neg is None
            continue
        up, down = max(0, v - x - sigma / 2 + up), max(0, x - sigma / 2 - v + down)
        assert near(r.value, up, 1e-9) and near(r.c_minus_neg, -down, 1e-9) and r.signal_upper == (up > 5 * sigma)


def test_many_series_are_as_each_alone(spark):
    a, b = [10, 11] * 10 + [30, 31] * 5, [None, 1, 2, 3, 4, 5, 6, 7, 8]
    both = charts.build(points(spark, a, key="a").union(points(spark, b, key="b")), keys=["k"])
    drop = lambda rows: [tuple(r)[1:] for r in rows]
    assert drop(both.where("k = 'b'").orderBy("idx").collect()) == drop(built(spark, b))
    assert charts.segments(both, ["k"]).where("k = 'a'").count() == 2


def test_status(spark):
    status = lambda values, kind, n=None, spread=None: series_status(points(spark, values, n, spread), kind, ["k"]).first().status
    assert status([None], "c") == "No valid data points" and status([1], "p", 0.0) == "No valid sample sizes" and status([1], "c") is None
    assert status([1, 2], "xbar-r", 1.0, 1.0) == "Subgroup size must be a whole number from 2 to 25"
    assert status([1, 2], "xbar-r", [5.0, 4.0], 1.0) == "Subgroup size must be constant across subgroups"
    assert status([1, 2], "xbar-r", 5.0) == "No valid subgroup ranges or std devs" and status([1, 2], "xbar-s", 5.4, 1.0) is None
    assert option_message("ewma", Options(ewma_lambda=0)) and option_message("ma", Options(ma_window=1)) and option_message("cusum", Options(cusum_k=0)) and not option_message("ewma", Options())
    with pytest.raises(BindingError, match="p-chart needs a Sample size field"):
        check_roles("p", Roles(axis=("d",), measure="m"))
    with pytest.raises(BindingError, match="an axis field and a measurement"):
        Roles().check()
    assert Options(sigmas=-1).sigmas == 3 and charts.chart_kind("pie") == "individuals"


def test_the_first_value_column_is_the_fallback(spark):
    df = spark.createDataFrame([(2.0, 6.0, 1.0), (1.0, 5.0, 1.0)], "x double, m double, other double")
    assert [r.value for r in sources.extract(df, Roles(axis=("x",))).orderBy("idx").collect()] == [5, 6]
    for roles in (Roles(axis=("x",), tooltips=("m",)), Roles(axis=("x",), target="m"), Roles()):
        with pytest.raises(BindingError):
            sources.extract(df, roles)
    with pytest.raises(BindingError, match="p-chart needs a Sample size field"):
        chart_table(df, Roles(axis=("x",), measure="m"), "p")
    with pytest.raises(BindingError, match="Subgroup range or std dev"):
        chart_table(df, Roles(axis=("x",), measure="m", sample_size="other"), "xbar-r")
    assert chart_table(df, Roles(axis=("x",))).count() == 2


def test_unnumbered_points_fail(spark):
    for gone in ("idx > 1", "idx <> 2"):
        with pytest.raises(Exception, match="numbered from 1 without a gap"):
            charts.build(points(spark, [1, 2, 3]).where(gone), "individuals", ["k"]).collect()


def test_files(spark, tmp_path):
    (tmp_path / "rates.csv").write_text("Month,Rate\n2023-01-31,2.45\n2023-01-01,2.46\n2023-03-02,x\n")
    df = files.csv(spark, str(tmp_path / "rates.csv"), "Month date, Rate double")
    assert [(r.label, r.value) for r in sources.extract(df, Roles(axis=("Month",))).orderBy("idx").collect()] == [("2023-01-01", 2.46), ("2023-01-31", 2.45), ("2023-03-02", None)]
    assert chart_table(files.sample(spark), Roles(axis=("month",))).first().change_at == 33


def test_companion_extent(spark):
    top = lambda values: charts.companion_extent(charts.build(points(spark, values), keys=["k"]), ["k"]).first()
    assert near(top([1, 3, 2, 9]).high, 1.05 * 3.267 * 10 / 3, 1e-9) and tuple(top([5, 5])[1:]) == (0, 1) and tuple(top([None])[1:]) == (0, 1)


def test_helpers(spark):
    df = spark.createDataFrame([("2024-01-01", 1.0), ("2024-01-03", 3.0), ("2024-01-03", 4.0)], "d string, m double").withColumn("d", F.to_date("d"))
    roles = Roles(axis=("d",), measure="m")
    rows = sources.extract(sources.completed(sources.aggregated(df, roles), roles), roles).orderBy("idx").collect()
    assert [r.value for r in rows] == [1, None, 7]
    ranges = spark.createDataFrame([("2024-01-01", "2024-01-02", 5.0), ("2024-01-01", "2024-01-01", 6.0)], "a string, b string, v double")
    assert [r.target for r in targets.range_target(df, ranges, "d", "a", "b", "v").orderBy("m").collect()] == [6, None, None]
    full = charts.build(points(spark, [1, 2, 50, 2, 1], None), "individuals", ["k"])
    text = {r.name: r.text for r in explain.explanations(full, ["k"]).where("idx = 3").collect()}
    assert text["Value"] == "50.00" and "Phase" not in text
    arms = {r.name for r in explain.explanations(charts.build(points(spark, [1, 2, 50]), "cusum", ["k"]), ["k"], "cusum").collect()}
    assert "CUSUM C⁻" in arms and "UCL" not in arms
    low, high = charts.extent(charts.build(points(spark, [5] * 3), "c", ["k"]), ["k"]).select("low", "high").first()
    assert low < 5 < high and charts.labelled(full, "off").count() == 0 and charts.labelled(full, "all").count() == 5
    assert charts.selected(full, spark.createDataFrame([(2,)], "category_index long")).first().value == 50


def test_null_keys_are_keys(spark):
    """Status, completion and selection of a series whose key is null are as those of any other."""
    for key in (None, "a"):
        gaps = points(spark, [None, None], key=key).union(points(spark, [1, 2], key="z"))
        out = chart(gaps, keys=["k"]).collect()
        assert len(out) == 4 and [r.status for r in out if r.k == key] == ["No valid data points"] * 2 and [r.status for r in out if r.k == "z"] == [None] * 2
        df = spark.createDataFrame([(key, "2024-01-01", 1.0), (key, "2024-01-04", 3.0), ("z", "2024-01-02", 4.0)], "k string, d string, m double").withColumn("d", F.to_date("d"))
        full = sources.completed(df, Roles(axis=("d",), measure="m", keys=("k",)))
        assert sorted(((r.k, str(r.d), r.m) for r in full.collect()), key=str) == sorted([(key, "2024-01-01", 1.0), (key, "2024-01-02", None), (key, "2024-01-03", None), (key, "2024-01-04", 3.0), ("z", "2024-01-02", 4.0)], key=str)
        chosen = spark.createDataFrame([(key, 1), ("z", 0)], "k string, category_index long")
        assert sorted(((r.k, r.idx) for r in charts.selected(gaps, chosen).collect()), key=str) == sorted([(key, 2), ("z", 1)], key=str)


def test_numbers_are_written_by_their_exact_value(spark):
    rng = random.Random(1)
    some = [1.005, 0.005, 10.125, -10.125, 2.675, 99.995, -0.001, 5e-324, 2.0**52 + 0.5, 123456789012345680000.0]
    some += [rng.choice([rng.gauss(0, 100), rng.randint(-(10**6), 10**6) / 8, rng.randint(-(10**6), 10**6) / 1000, rng.random() * 10 ** rng.randint(-8, 20)]) for _ in range(2000)]
    got = spark.createDataFrame([(x,) for x in some], "x double").select("x", *[explain.fixed(F.col("x"), p).alias(f"p{p}") for p in (0, 1, 2)]).collect()
    with decimal.localcontext(prec=80):
        for r in got:
            for p in (0, 1, 2):
                exact = decimal.Decimal(abs(r.x)).quantize(decimal.Decimal(1).scaleb(-p), rounding=decimal.ROUND_HALF_UP)
                assert r[f"p{p}"] == ("-" if r.x < 0 else "") + format(exact, "f")
    odd = [(-0.0, "0.00"), (0.0, "0.00"), (float("nan"), ""), (float("-inf"), ""), (1e21, "1e+21"), (1.5e25, "1.5e+25"), (None, None)]
    assert [r[0] for r in spark.createDataFrame(odd, "x double, y string").select(explain.two_places(F.col("x"))).collect()] == [y for _, y in odd]
    arms = explain.explanations(charts.build(points(spark, [1, 2, 50]), "cusum", ["k"]), ["k"], "cusum").where("name = 'CUSUM C⁻'").orderBy("idx").collect()
    assert arms[-1].text == "0.00"


def test_values_are_named_and_written_as_their_chart_does(spark):
    text = lambda kind, *more: [(r.name, r.text) for r in explain.value_texts(charts.build(points(spark, *more), kind, ["k"]), ["k"], kind).orderBy("idx").collect()]
    assert text("p", [5, 10, None], [100.0, 80.0, 1.0]) == [("Proportion", "5.0%"), ("Proportion", "12.5%")]
    assert text("u", [5], 2.0) == [("Defects per unit", "2.50")] and text("c", [5]) == [("Value", "5.00")] and text("ewma", [5])[0][0] == "EWMA"
    assert {k: (x.value_label, x.value_format) for k, x in charts.CHARTS.items() if x.value_label} == {"p": ("Proportion", "0.0%"), "u": ("Defects per unit", None), "ewma": ("EWMA", None), "ma": ("Moving average", None), "cusum": ("CUSUM", None)}


def test_lines(spark):
    full = charts.build(points(spark, [None, 1, 2, None, 3, None, 4, 5]), keys=["k"])
    assert [tuple(r)[1:] for r in lines.runs(full, ["k"]).orderBy("run").collect()] == [(1, 2, 3, 2), (2, 5, 5, 1), (3, 7, 8, 2)]
    assert lines.runs(full, ["k"], "target").count() == 0
    steps = lines.limit_runs(charts.build(points(spark, [1, 2, 3, None, 4], [10.0, 10.0, 20.0, 20.0, 20.0]), "p", ["k"]), ["k"]).orderBy("run").collect()
    assert [(r.run, r.start_index, r.end_index) for r in steps] == [(1, 1, 2), (2, 3, 3), (3, 5, 5)] and near(steps[1].ucl, steps[2].ucl)
    both = lines.segment_ranges(charts.build(points(spark, [10] * 15 + [20] * 15), keys=["k"]), ["k"]).orderBy("segment").collect()
    assert [(r.left, r.right, r.phase_line) for r in both] == [(0.5, 15.5, None), (15.5, 30.5, 15.5)] and both[1].center == 20
    one = lines.segment_ranges(charts.build(points(spark, [1, 2, 3]), "c", ["k"]), ["k"]).collect()
    assert [(r.left, r.right, r.phase_line) for r in one] == [(0.5, 3.5, None)]


def test_every_constant_is_that_of_its_formula(spark):
    """All sizes from 2 to 25: mean and deviation of the range of normal readings by integrals, c4 by the gamma function."""
    import numpy as np

    x = np.linspace(-9, 9, 4001)
    step, cdf = x[1] - x[0], np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in x])
    names = [F.struct(*[constant(n, F.col("m")).alias(n) for n in CONSTANT_NAMES]).alias("c")]
    for m, got in spark.range(2, 26).select(F.col("id").alias("m"), *names).collect():
        d2 = float((1 - cdf**m - (1 - cdf) ** m).sum() * step)
        upper = cdf[None, :] - cdf[:, None]
        both = 1 - cdf[None, :] ** m - (1 - cdf[:, None]) ** m + np.maximum(0, upper) ** m
        d3 = math.sqrt(2 * float((np.triu(both).sum() - np.trace(both) / 2) * step * step) - d2 * d2)
        c4 = math.sqrt(2 / (m - 1)) * math.exp(math.lgamma(m / 2) - math.lgamma((m - 1) / 2))
        spread, wide = 3 * d3 / d2, 3 * math.sqrt(1 - c4 * c4) / c4
        want = [3 / (d2 * math.sqrt(m)), 3 / (c4 * math.sqrt(m)), max(0, 1 - spread), 1 + spread, max(0, 1 - wide), 1 + wide]
        assert all(abs(a - b) < 0.003 for a, b in zip(got, want, strict=True)), (m, got, want)
    assert all(constant(n, F.lit(m)) is not None for n in CONSTANT_NAMES for m in (1, 26))

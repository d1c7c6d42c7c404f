"""Charts in blocks are those of whole series, wherever a series is cut."""

import random

import pytest
from pyspark.sql import functions as F

from statrill.operators import ranges
from statrill.plans import charts, ranged
from statrill.plans.options import Options
from statrill.sources import extract as sources
from statrill.sources.roles import Roles
from statrill.sources.shared import written

ROLES = Roles(axis=("x",), measure="v", sample_size="s", spread="d", keys=("k",), ordinal="o", tooltips=("d",))
SCHEMA = "k string, o int, x int, v double, s double, d double"


def table(spark, sizes=((None, 70), ("a", 60), ("b", 7)), seed=5):
    rng, rows = random.Random(seed), []
    for k, n in sizes:
        for i in range(n):
            value = None if rng.random() < 0.08 else round(rng.gauss(10 + 3 * (i > 40), 1), 2)
            rows.append((k, i, rng.randint(0, 40) if k else None if i % 9 == 0 else i // 2, value, float(rng.randint(0, 6)) or None, rng.random() if i % 5 else None))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def listed(df):
    columns = sorted(df.columns)
    return columns, sorted(([r[c] for c in columns] for r in df.collect()), key=lambda r: (str(r[columns.index("k")]), r[columns.index("idx")]))


def alike(x, y):
    return abs(x - y) <= 1e-9 * max(1, abs(x)) if isinstance(x, float) and isinstance(y, float) else x == y


def assert_alike(one, other):
    (columns, rows), (names, others) = listed(one), listed(other)
    assert columns == names and len(rows) == len(others)
    for a, b in zip(rows, others, strict=True):
        wrong = [(c, x, y) for c, x, y in zip(columns, a, b, strict=True) if not alike(x, y)]
        assert not wrong, wrong


def test_numbers_are_those_of_one_window(spark):
    df = table(spark)
    for most in (None, 20):
        assert_alike(sources.extract(df, ROLES, most), ranged.extract(df, ROLES, most, size=9))
    text = df.withColumn("x", F.col("x").cast("string"))
    assert_alike(sources.extract(text, ROLES), ranged.extract(text, ROLES, size=9))
    assert ranged.extract(df.limit(0), ROLES).count() == 0
    with pytest.raises(ValueError, match="ordinal"):
        ranged.extract(text, Roles(axis=("x",), measure="v"))


def test_no_range_grows_with_a_tie_or_a_series(spark, monkeypatch):
    """Rows of one series and one axis value are dealt out all the same."""
    held = []
    monkeypatch.setattr(ranges, "written", lambda df: held.append(written(df)) or held[-1])
    df = ranges.keyed(spark.range(40_000).select(F.lit(1).alias("x")), ())
    out = ranges.numbered_rows(df, [F.col("x")], "n", size=4_000)
    sizes = sorted(r["count"] for r in held[0].groupBy("range_").count().collect())
    assert len(sizes) >= 8 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    assert [r.n for r in out.select("n").orderBy("n").collect()] == list(range(1, 40_001))


def test_ranges_do_not_grow_with_short_blocks():
    """The driver draws the borders of ranges from a sample of each, so short ranges stay few."""
    assert [ranges.ranges_of(n, 1024) for n in (0, 1, 10_000, 6_000_000, 36_000_000)] == [1, 1, 10, 64, 64]
    assert ranges.ranges_of(10**10, 1024) == ranges.ranges_of(10**10, ranges.SIZE) == 9_537 and ranges.ranges_of(40_000, 4_000) == 10


@pytest.mark.parametrize("kind", charts.CHARTS)
@pytest.mark.parametrize("size", [1, 23])
def test_charts_are_those_of_whole_series(spark, kind, size):
    points, o = sources.extract(table(spark), ROLES), Options(ewma_lambda=0.3)
    assert_alike(charts.build(points, kind, ["k"], o), ranged.build(points, kind, ["k"], o, size))


@pytest.mark.parametrize("weight", [0.01, 0.2, 0.9, 1.0, 0.0])
def test_decayed_means_compose(spark, weight):
    """Maps of blocks far shorter, and far longer, than what an EWMA remembers; a block of gaps is between them."""
    rng = random.Random(3)
    values = [None] * 40 + [None if 100 < i < 130 or rng.random() < 0.1 else rng.gauss(10, 2) for i in range(900)]
    points = spark.createDataFrame([("a", i + 1, i, str(i), v, None, None, None) for i, v in enumerate(values)], "k string, idx int, category_index long, label string, value double, target double, sample_size double, spread double")
    real = [v for v in values if v is not None]
    z, want = sum(real) / len(real), []
    for v in values:
        z = z if v is None else weight * v + (1 - weight) * z
        want.append(None if v is None else z)
    for size in (13, 400, 5000):
        got = [r.value for r in ranged.build(points, "ewma", ["k"], Options(ewma_lambda=weight), size).orderBy("idx").collect()]
        assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-9) for a, b in zip(got, want, strict=True)), size


@pytest.mark.parametrize("values", [[0.1] * 30 + [0.2] * 30, [5.0] * 40, [10.0, 11.0] * 20 + [30.0, 31.0] * 10, [1e6 + i % 3 for i in range(60)] + [1e6 + 5 + i % 3 for i in range(40)]])
def test_moments_merge_to_the_same_split(spark, values):
    """Flat sides have no variance, and of equal statistics the earliest counts, on either side of a border."""
    points = spark.createDataFrame([("a", i + 1, i, str(i), v, None, None, None) for i, v in enumerate(values)], "k string, idx int, category_index long, label string, value double, target double, sample_size double, spread double")
    want = charts.build(points, keys=["k"]).select("change_at", "best_split", "best_statistic", "significant").first()
    for size in (1, 7, 30, 31):
        got = ranged.build(points, keys=["k"], size=size).select("change_at", "best_split", "best_statistic", "significant").first()
        assert [*got[:2], got[3]] == [*want[:2], want[3]] and abs(got[2] - want[2]) <= 1e-9 * want[2], size


def test_options_reach_the_blocks(spark):
    points = sources.extract(table(spark), ROLES)
    for kind, o in (("individuals", Options(manual=20.5, sigmas=2.0, floor=False)), ("individuals", Options(detect=False, rules=frozenset({1, 5}))), ("ma", Options(ma_window=30)), ("cusum", Options(cusum_k=0.1, cusum_h=2))):
        assert_alike(charts.build(points, kind, ["k"], o), ranged.build(points, kind, ["k"], o, 11))

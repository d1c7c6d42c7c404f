"""Means and limits do not hang on the order in which rows are added up."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from statrill import queries
from statrill.plans import charts, ranged
from statrill.sources import extract as sources
from statrill.sources.roles import Roles

ROLES = Roles(axis=("i",), measure="v", keys=("k",))


def test_nothing_fires_in_a_flat_phase(spark):
    """Sums of equal values, over their number, are often not that value."""
    levels = [86.58, 7.22, 160.53, 32.9, 100.82, 0.1, 0.7, 1.1]
    df = spark.createDataFrame([(k, i, v if i < 60 else w) for k, (v, w) in enumerate(zip(levels, levels[1:], strict=False)) for i in range(120)], "k int, i int, v double")
    points = sources.extract(df, ROLES)
    for built in (charts.build(points, keys=["k"]), ranged.build(points, keys=["k"], size=50)):
        assert built.where("change_at = 61").count() == 120 * 7
        assert built.where("violation").count() == 0 and built.where("ucl <> value or center <> value").count() == 0


@pytest.mark.parametrize("name", ["spc_individuals", "spc_guarded_options", "spc_explanations"])
def test_flat_phases_and_ties_with_the_center_are_those_of_the_sql(spark, tmp_path, name):
    """Series of three kinds: flat at two levels; readings of which some are exactly their mean; copies of each reading."""
    rng, rows = random.Random(1), []
    for user in range(12):
        level = [round(rng.uniform(0, 200), 2) for _ in range(2)]
        for i in range(120):
            v = level[i >= 60] if user < 4 else round(10 + (i % 7 - 3) * 0.1, 2) if user < 8 else round(50 + 9 * ((user * 7 + i // 30) % 5) / 3, 2)
            rows.append((user * 1000 + i, user, i, "view" if i % 13 else "error", v))
    df = spark.createDataFrame(rows, "event_id long, user_id long, i int, event_type string, value double")
    df.select("event_id", F.timestamp_seconds(1_700_000_000 + F.col("i") * 60).cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value").write.parquet(f"{tmp_path}/events.parquet")
    got = __spark_entry__.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    rel = con.sql(__spark_entry__.oracle_sql()[name])
    want = sorted(map(repr, rel.fetchall()))
    assert len(want) > 1000 and sorted(repr(tuple(r)) for r in got.select(*rel.columns).collect()) == want


def test_the_planted_series_is_charted_in_blocks(spark, tmp_path, monkeypatch):
    """It grows with the table, so no task may hold all of it."""
    sizes, build = [], ranged.build
    monkeypatch.setattr(ranged, "build", lambda *a, **k: sizes.append(k["size"]) or build(*a, **k))
    monkeypatch.setattr(queries, "PLANTED_SIZE", 300)
    spark.range(2_000).select(F.col("id").alias("event_id"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts")).write.parquet(f"{tmp_path}/events.parquet")
    got = {tuple(r) for r in queries.spc_planted_rules(spark, str(tmp_path)).select("rule_id", "n", "places").collect()}
    con = duckdb.connect()
    con.sql(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert got == set(con.sql(queries.ORACLE_SQL["spc_planted_rules"]).fetchall()) and sizes == [300]

"""Steps that large tables need: what is worked on once, and what no task holds whole."""

import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelag.functions import windows as W
from tidelag.operators import joins
from tidelag.plans import models, registry

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_a_ladder_is_searched_once(spark):
    found = plan(spark, "ladder_inversion")
    assert found.index("Join") < found.index("Aggregate [p_size")


@pytest.mark.parametrize("name", ["spearman_group", "season_to_date_accuracy"])
def test_no_window_over_the_rows_of_a_group(spark, name):
    windows = [line for line in plan(spark, name).splitlines() if "Window [" in line]
    assert not any("rank(" in line or "count(1) windowspec" in line for line in windows)


def test_rank_averages(spark):
    values = [1.5, 1.5, 1.25, -0.5, 7.0, None, math.nan, math.inf, -math.inf, 7.0, 1e300]
    df = spark.createDataFrame([(g, v) for g in (1, 2, None) for v in values] + [(2, 1.5)], "g int, v double")
    want = df.select("g", "v", W.rank_average(Window.partitionBy("g").orderBy("v"), Window.partitionBy("g", "v")).alias("r"))
    assert sorted(map(repr, W.with_rank_averages(df, ("g",), {"v": "r"}).collect())) == sorted(map(repr, want.collect()))
    counted = df.groupBy("g", "v").agg(F.count("*").alias("n"))
    assert sorted(map(repr, W.with_rank_averages(counted, ("g",), {"v": "r"}, "n").select("g", "v", "r").collect())) == sorted(map(repr, want.distinct().collect()))


def test_features_are_stored_once(spark, monkeypatch):
    seen = []
    kept = models.stored
    monkeypatch.setattr(models, "stored", lambda df, name: seen.append(name) or kept(df, name))
    assert models.ridge_walk_forward(spark, SF).count() and seen == ["features"]


@pytest.mark.parametrize("name", ["drive_two_level", "possession_max_sum"])
def test_drives_are_dealt_before_they_are_added_up(spark, monkeypatch, name):
    monkeypatch.setattr(joins, "DEALT_ROWS", 100)
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    q = registry.QUERIES[name](spark, SF)
    found = q._jdf.queryExecution().executedPlan().toString()
    assert found.count("Exchange ") == 1 and f"{-(-rows // 100)})" in found[found.index("Exchange ") :].splitlines()[0].replace(",", ")")
    lines = found.splitlines()
    assert max(i for i, line in enumerate(lines) if "HashAggregate" in line) < next(i for i, line in enumerate(lines) if "Exchange " in line)

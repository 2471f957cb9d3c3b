"""Formulas of projections and grading by answers worked out by hand."""

import math

from pyspark.sql import functions as F

from tidelag.plans import adjusters as A


def test_touchdowns_by_yardage_and_position(spark):
    rows = [("QB", 250.0, 2.0, 0.25 * 2 + 0.75 * 250 * 0.00626), ("RB", 250.0, 2.0, 2.0), ("QB", -10.0, 1.0, 0.25), ("K", 100.0, 1.0, 1.0)]
    d = spark.createDataFrame(rows, "position string, yards double, tds double, want double")
    for r in d.select("want", A.drawn_to_rate("passing", F.col("position"), F.col("yards"), F.col("tds")).alias("got")).collect():
        assert abs(r["got"] - r["want"]) < 6e-4
    rb = d.where("position = 'RB'").select(A.drawn_to_rate("rushing", F.col("position"), F.lit(100.0), F.lit(0.2)).alias("got")).first()["got"]
    assert rb == 0.741  # fully by yardage


def test_roles_and_team_codes(spark):
    rows = [(0.61, None, "starter"), (0.60, None, "backup"), (0.30, None, "backup"), (0.29, 0.9, "unknown"), (None, 0.16, "backup"), (None, 0.15, "unknown"), (None, None, "unknown")]
    d = spark.createDataFrame(rows, "snaps double, share double, want string")
    assert all(r["want"] == r["got"] for r in d.select("want", A.role_of(F.col("snaps"), F.col("share")).alias("got")).collect())
    codes = {"KAN": "KC", " jac ": "JAX", "sfo": "SF", "LAR": "LA", "KC": "KC", "": "", None: "", "xyz": "XYZ"}
    d = spark.createDataFrame([(c,) for c in codes], "c string")
    assert {r["c"]: r["t"] for r in d.select("c", A.canonical_team(F.col("c")).alias("t")).collect()} == codes


def graded(flip=()):
    """Ten players at two positions over weeks 2 to 5; in weeks of flip our order of runners is turned around."""
    rows = []
    for week in (2, 3, 4, 5):
        for position in ("RB", "WR"):
            for i in range(10):
                ours = 10.0 + (9 - i if position == "RB" and week in flip else i)
                rows.append((2024, week, position, ours, 8.0 + i, 10.0 + i))
        rows.append((2024, week, "RB", 0.0, 4.9, 99.0))  # below the least consensus
        rows.append((2024, week, "K", 0.0, 9.0, 99.0))  # no graded position
    return rows


SCHEMA = "season int, week int, position string, ours double, theirs double, actual double"


def test_season_to_date_table_and_gate(spark):
    got = {(r["week"], r["position"]): r for r in A.cumulative_accuracy(spark.createDataFrame(graded(), SCHEMA), ("RB", "WR", "TE")).collect()}
    assert set(got) == {(w, p) for w in (3, 4, 5) for p in ("RB", "WR", "OVERALL")}
    last = got[5, "OVERALL"]
    assert last["n"] == 60 and last["weeks"] == 3 and last["mae"] == 0 and last["rival_mae"] == 2 and last["gate"] and last["rank_gap"] is None
    assert got[4, "RB"]["n"] == 20 and got[4, "RB"]["gap"] == -2 and abs(got[4, "RB"]["rank_gap"]) < 1e-12


def test_one_position_out_of_order_closes_the_gate_for_all(spark):
    # in week 4 our order of runners is the reverse: mean error of runners (0 + 5) / 2, of all 1.25, still below 2
    got = {(r["week"], r["position"]): r for r in A.cumulative_accuracy(spark.createDataFrame(graded(flip=(4,)), SCHEMA), ("RB", "WR", "TE")).collect()}
    assert got[3, "WR"]["gate"] and not got[4, "WR"]["gate"] and not got[4, "OVERALL"]["gate"]
    assert math.isclose(got[4, "OVERALL"]["mae"], 1.25) and math.isclose(got[4, "RB"]["rank_gap"], -1.0) and math.isclose(got[5, "RB"]["rank_gap"], -2 / 3)


def test_too_few_ranked_rows_close_the_gate(spark):
    rows = [r for r in graded() if r[2] != "WR" or r[3] < 15]
    assert not any(r["gate"] for r in A.cumulative_accuracy(spark.createDataFrame(rows, SCHEMA), ("RB", "WR")).collect())
    assert A.cumulative_accuracy(spark.createDataFrame([], SCHEMA), ("RB",)).count() == 0

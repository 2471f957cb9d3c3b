"""Schemes, front sevens, expected points and quality factors on rows worked out by hand."""

from pyspark.sql import functions as F

from tidelag.functions import windows as W
from tidelag.operators import team_profiles as T

PLAYS = "team string, season int, play_type string, run_gap string, run_location string, shotgun int, no_huddle int"


def runs(team, gaps, sides, shotgun, n=20):
    return [(team, 2020, "run", gaps[i % len(gaps)], sides[i % len(sides)], shotgun, None) for i in range(n)]


def test_first_rule_that_holds_names_the_scheme(spark):
    data = runs("ends", ["end", "guard"], ["left"], 1) + runs("even", ["guard"], ["left", "middle", "right"], 1, 21) + runs("inner", ["guard", "tackle", "tackle", None, "end"], ["left"], 1)
    data += runs("gun", [None, "guard"], ["left"], 1) + runs("none", [None], ["left"], None) + [("pass", 2020, "pass", "end", "left", 1, 1), (None, 2020, "run", "end", "left", 1, 1)]
    got = {r.team: r for r in T.run_schemes(spark.createDataFrame(data, PLAYS)).collect()}
    assert {k: v.scheme_type for k, v in got.items()} == {"ends": "zone", "even": "zone", "inner": "gap_power", "gun": "spread", "none": "balanced"}
    assert (got["inner"].run_gap_tackle_rate, got["inner"].run_gap_end_rate, got["none"].shotgun_rate, got["even"].run_loc_middle_rate) == (0.4, 0.2, 0.0, 0.3333)


def test_front_seven_counts_known_fronts_and_unknown_players(spark):
    d = [("end", "A", 2020, w, 1, 2, None, 4) for w in (1, 2, 3, 4, 5)] + [("corner", "A", 2020, w, 50, 50, 50, 50) for w in (1, 2, 3, 4, 5)] + [("new", "A", 2020, 1, 0, 0, 0, 10)]
    d = spark.createDataFrame(d, "player string, team string, season int, week int, sacks int, pressures int, hurries int, tackles int")
    roster = spark.createDataFrame([("end", "A", 2020, "DE"), ("corner", "A", 2020, "CB"), ("end", "B", 2020, "CB")], "player string, team string, season int, position string")
    got = {r.week: r for r in T.front_seven(d, roster).collect()}
    assert got[1].front7_quality is None and (got[2].front7_tackles, got[2].front7_hurries) == (14.0, 0.0)
    assert abs(got[2].front7_quality - (0.3 + 0.6 + 0.2 * 14)) < 1e-9 and abs(got[5].front7_quality - (0.3 + 0.6 + 0.8)) < 1e-9
    quiet = d.where("player = 'new'").withColumn("tackles", F.lit(1)).unionByName(d.where("player = 'new'").withColumn("week", F.lit(2)))
    assert [r.front7_tackles for r in T.front_seven(quiet).orderBy("week").collect()] == [None] or [r.week for r in T.front_seven(quiet).collect()] == [2]


def test_expected_points(spark):
    cols = "player string, team string, season int, week int, position string, exp_points double, points_over_expected double, pass_exp_points double, rush_exp_points double, rec_exp_points double, exp_tds double, tds double, targets double, carries double"
    data = [("a", "A", 2020, 1, "RB", 10.0, 2.0, None, 8.0, 2.0, 0.5, 1.0, 2.0, 6.0), ("b", "A", 2020, 1, "RB", 4.0, None, None, 4.0, None, 0.5, 0.0, None, 2.0), ("c", "A", 2020, 1, "WR", 6.0, -1.0, None, None, 6.0, 1.0, 0.0, 6.0, None), ("c", "A", 2020, 2, "WR", 3.0, 0.0, None, None, 3.0, 0.0, 0.0, 0.0, None)]
    one, two = T.expected_points(spark.createDataFrame(data, cols)).orderBy("week").collect()
    assert (one.ep_exp_points, one.ep_over_expected, one.ep_exp_pass, one.ep_exp_rush, one.ep_exp_rec, one.ep_exp_tds, one.ep_tds_over_expected) == (20.0, 1.0, 0.0, 12.0, 8.0, 2.0, -1.0)
    assert (one.ep_opportunity_hhi, one.ep_rush_share_hhi, one.ep_exp_points_roll3) == ((64 + 4 + 36) / 256, (36 + 4) / 64, None)
    assert (two.ep_opportunity_hhi, two.ep_rush_share_hhi, two.ep_exp_points_roll3, two.ep_rush_share_hhi_std) == (0.0, None, 20.0, 0.625)


def test_quality_factor(spark):
    quality = spark.createDataFrame([("a", 2020, 1, 9.0), ("a", 2020, 2, 2.0), ("b", 2019, 9, 4.0), ("c", 2020, 1, 12.0)], "player string, season int, week int, quality double")
    points = spark.createDataFrame([(p, 10.0, "kept") for p in "abcd"], "player string, points double, note string")
    got = {r.player: (r.points, r.factor, r.note) for r in T.with_quality_factor(points, quality).collect()}
    assert got == {"a": (9.6, 0.96, "kept"), "b": (10.0, 1.0, "kept"), "c": (10.8, 1.08, "kept"), "d": (9.5, 0.95, "kept")}
    assert [(r.points, r.factor) for r in T.with_quality_factor(points.limit(1), quality.limit(0)).collect()] == [(10.0, None)]


def test_prior_medians(spark):
    d = spark.createDataFrame([(1, 1, 5.0), (2, 1, 7.0), (3, 1, None), (1, 2, 100.0), (1, 4, 1.0), (2, 8, 1.0)], "player int, week int, x double").withColumns({"g": F.lit("g"), "season": F.lit(2020)})
    got = {(r.player, r.week): (r.recent_mean, r.group_median, r.ratio) for r in T.to_prior_median(d, "x", ("g",), 3).collect()}
    assert got[1, 1] == (None, None, None) and got[1, 2] == (5.0, 6.0, 5 / 6) and got[1, 4] == (52.5, 7.0, 7.5) and got[2, 8] == (7.0, None, None)


def test_lagged_median(spark):
    d = spark.createDataFrame(list(enumerate([3.0, None, 1.0, 9.0, 4.0])), "t int, x double").withColumn("m", W.lagged_median("x", W.by((), ("t",)), 3, 2))
    assert [r.m for r in d.orderBy("t").collect()] == [None, None, None, 2.0, 5.0]

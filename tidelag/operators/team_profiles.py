"""Profiles of teams from their plays and players: run schemes, front sevens, expected points, quality factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelag.functions import windows as W
from tidelag.functions.scalars import clip, fixed, ratio
from tidelag.sources.sinks import latest_rows

TEAM_WEEK = ("team", "season", "week")

# Limits of the schemes, weights of the front seven, strength and range of the quality factor.
ZONE_END, INNER_GAPS, SPREAD_SHOTGUN, BALANCED_WITHIN = 0.35, 0.50, 0.60, 0.15
FRONT_SEVEN = {"sacks": 0.3, "pressures": 0.3, "hurries": 0.2, "tackles": 0.2}
HIGH_TACKLES = 5
FRONT_POSITIONS = ("DE", "DT", "NT", "LB", "ILB", "OLB", "MLB", "EDGE")
FACTOR_STEP, FACTOR_RANGE = 0.02, (0.95, 1.08)
SEPARATION_WEIGHT, AFTER_CATCH_WEIGHT = 0.5, 0.3


def run_schemes(plays: DataFrame) -> DataFrame:
    """Scheme of each team and season by how its runs are dealt over gaps and sides, with the rates.

    plays has team, season, play_type, run_gap, run_location, shotgun, no_huddle; unknown gaps and sides count
    in the denominators, unknown shotgun and huddle as no. One aggregate; the first rule that holds names it.
    """
    share = lambda c, v: F.avg(F.coalesce((F.col(c) == v).cast("int"), F.lit(0)))
    rates = {f"run_gap_{v}_rate": share("run_gap", v) for v in ("end", "tackle", "guard")} | {f"run_loc_{v}_rate": share("run_location", v) for v in ("left", "middle", "right")}
    rates |= {f"{c}_rate": F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))) for c in ("shotgun", "no_huddle")}
    t = plays.where("play_type = 'run' AND team IS NOT NULL").groupBy("team", "season").agg(*[v.alias(k) for k, v in rates.items()])
    balanced = F.lit(True)
    for side in ("left", "middle", "right"):
        balanced &= F.abs(F.col(f"run_loc_{side}_rate") - F.lit(1 / 3)) < BALANCED_WITHIN
    scheme = (
        F.when((F.col("run_gap_end_rate") > ZONE_END) | balanced, "zone")
        .when(F.col("run_gap_guard_rate") + F.col("run_gap_tackle_rate") > INNER_GAPS, "gap_power")
        .when(F.col("shotgun_rate") > SPREAD_SHOTGUN, "spread")
        .otherwise("balanced")
    )
    return t.select("team", "season", scheme.alias("scheme_type"), *[fixed(c, 4).alias(c) for c in rates])


def front_seven(defenders: DataFrame, roster: DataFrame | None = None, positions: tuple[str, ...] = FRONT_POSITIONS) -> DataFrame:
    """Mean sacks, pressures, hurries and tackles of a front seven in the three games before, and their composite.

    defenders has player, team, season, week and the four stats. roster (player, team, season, position) keeps
    players of the positions and those that it does not know; without one, players with a sack, pressure, hurry
    or many tackles are kept, or all if there are none such.
    """
    stats, d = list(FRONT_SEVEN), defenders
    if roster is not None:
        known = latest_rows(roster.where("position IS NOT NULL"), ["player", "team", "season"], ["position"])
        others = known.where(~F.col("position").isin(*positions)).select("player", "team", "season")
        d = d.join(others, ["player", "team", "season"], "left_anti")
    else:
        active = (F.greatest(*[F.coalesce(F.col(c), F.lit(0)) for c in stats[:3]]) > 0) | (F.coalesce(F.col("tackles"), F.lit(0)) >= HIGH_TACKLES)
        any_active = d.agg(F.coalesce(F.max(active.cast("int")), F.lit(0)).alias("__any"))  # one row
        d = d.join(F.broadcast(any_active)).where(active | (F.col("__any") == 0))
    t = d.groupBy(*TEAM_WEEK).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(c) for c in stats])
    t = t.withColumn("quality", sum((w * F.col(c) for c, w in FRONT_SEVEN.items()), F.lit(0.0)))
    w = W.by(("team", "season"), ("week",))
    return t.select(*TEAM_WEEK, *[W.lagged_mean(c, w, 3).alias(f"front7_{c}") for c in ("quality", *stats)])


def concentration(x: Column) -> Column:
    """Herfindahl index of non-negative values of a group from two sums; 0 where they add up to 0."""
    v = F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0))
    return ratio(F.sum(v * v), F.sum(v) * F.sum(v), 0.0)


def expected_points(players: DataFrame) -> DataFrame:
    """What a team's players were expected to score each week, against what they did, and means of earlier weeks.

    players: one row a player and week with position, exp_points and its pass_, rush_ and rec_ parts,
    points_over_expected, exp_tds, tds, targets, carries. Each of the nine measures comes with its mean of the
    3 and 6 weeks before and of all the season's before; the share of backs' carries is null without a back.
    """
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    back = F.col("position") == "RB"
    sums = {"exp_points": total("exp_points"), "over_expected": total("points_over_expected"), "exp_pass": total("pass_exp_points"), "exp_rush": total("rush_exp_points"), "exp_rec": total("rec_exp_points"), "exp_tds": total("exp_tds")}
    sums |= {"tds_over_expected": total("tds") - total("exp_tds"), "opportunity_hhi": concentration(F.coalesce(F.col("targets"), F.lit(0.0)) + F.coalesce(F.col("carries"), F.lit(0.0)))}
    sums |= {"rush_share_hhi": F.when(F.count_if(back) > 0, concentration(F.when(back, F.col("carries"))))}
    t = players.groupBy(*TEAM_WEEK).agg(*[v.alias(f"ep_{k}") for k, v in sums.items()])
    w = W.by(("team", "season"), ("week",))
    past = [W.lagged_mean(f"ep_{k}", w, n).alias(f"ep_{k}_{end}") for k in sums for n, end in ((3, "roll3"), (6, "roll6"), (None, "std"))]
    return t.select("*", *past)


def receiving_quality(weeks: DataFrame) -> DataFrame:
    """weeks (player, season, week, separation, after_catch) with both means of the three games before and their composite."""
    w = W.by(("player", "season"), ("week",))
    d = weeks.withColumns({f"{c}_r3": W.lagged_mean(c, w, 3) for c in ("separation", "after_catch")})
    known = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return d.withColumn("quality", fixed(known("separation_r3") * SEPARATION_WEIGHT + known("after_catch_r3") * AFTER_CATCH_WEIGHT, 3))


def with_quality_factor(projections: DataFrame, quality: DataFrame) -> DataFrame:
    """projections (player, points, ...) with `factor` and points times it, by each player's latest quality.

    A step for each unit above the median of the projections' known qualities other than 0; a player without
    one counts as 0. Without any, the factor is null and points stay.
    """
    latest = latest_rows(quality, ["player"], [F.desc("season"), F.desc("week")]).select("player", F.col("quality").alias("__q"))
    d = projections.join(latest, "player", "left").withColumn("__q", F.coalesce("__q", F.lit(0.0)))
    middle = d.agg(F.percentile(F.when(F.col("__q") != 0, F.col("__q")), 0.5).alias("__m"))  # one row
    factor = F.when(F.col("__m") != 0, clip(1 + (F.col("__q") - F.col("__m")) * FACTOR_STEP, *FACTOR_RANGE))
    d = d.join(F.broadcast(middle)).withColumn("__f", factor)
    return d.withColumns({"points": F.when(F.col("__f").isNotNull(), fixed(F.col("points") * F.col("__f"), 2)).otherwise(F.col("points")), "factor": fixed("__f", 4)}).drop("__q", "__m", "__f")


def to_prior_median(weeks: DataFrame, x: str, group: tuple[str, ...], n: int, recent: int = 3) -> DataFrame:
    """weeks with `recent_mean`, `group_median` and their `ratio`: a player's last games against all the group's n weeks before."""
    w = Window.partitionBy("player", "season").orderBy("week")
    d = W.with_prior_median(weeks, x, [*group, "season"], "week", n, "group_median")
    return d.withColumn("recent_mean", W.lagged_mean(x, w, recent)).withColumn("ratio", ratio("recent_mean", "group_median"))

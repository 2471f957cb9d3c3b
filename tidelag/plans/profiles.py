"""Run schemes, front sevens, expected points and quality factors over the plays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelag.functions.scalars import fixed
from tidelag.operators import team_profiles as T
from tidelag.plans.inputs import plays, query
from tidelag.sources.tables import table

_RATES = ("run_gap_end_rate", "run_gap_tackle_rate", "run_gap_guard_rate", "run_loc_left_rate", "run_loc_middle_rate", "run_loc_right_rate", "shotgun_rate", "no_huddle_rate")


def _pick(names: tuple[str | None, ...], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))


@query(f"""WITH {{plays}}, p AS (SELECT team, season, CASE WHEN team % 3 = 0 AND player % 2 = 0 THEN 'end' ELSE ['end', 'tackle', 'guard', NULL][CAST((player + game) % 4 + 1 AS INTEGER)] END AS gap, CASE WHEN team % 4 > 0 AND game % 2 = 0 THEN 'left' ELSE ['left', 'middle', 'right'][CAST(game % 3 + 1 AS INTEGER)] END AS side,
  CASE WHEN play_no < 7 THEN success END AS shotgun, CAST(player % 5 = 0 AS INTEGER) AS no_huddle FROM plays WHERE kind = 'run'),
t AS (SELECT team, season, count_if(gap = 'end') / count(*) AS run_gap_end_rate, count_if(gap = 'tackle') / count(*) AS run_gap_tackle_rate, count_if(gap = 'guard') / count(*) AS run_gap_guard_rate, count_if(side = 'left') / count(*) AS run_loc_left_rate, count_if(side = 'middle') / count(*) AS run_loc_middle_rate,
  count_if(side = 'right') / count(*) AS run_loc_right_rate, avg(coalesce(shotgun, 0)) AS shotgun_rate, avg(no_huddle) AS no_huddle_rate FROM p GROUP BY ALL)
SELECT team, season, CASE WHEN run_gap_end_rate > 0.35 OR (abs(run_loc_left_rate - 1 / 3) < 0.15 AND abs(run_loc_middle_rate - 1 / 3) < 0.15 AND abs(run_loc_right_rate - 1 / 3) < 0.15) THEN 'zone' WHEN run_gap_guard_rate + run_gap_tackle_rate > 0.5 THEN 'gap_power' WHEN shotgun_rate > 0.6 THEN 'spread' ELSE 'balanced' END AS scheme_type,
  {", ".join(f"round({c} + 1e-9, 4) AS {c}" for c in _RATES)} FROM t""")
def run_schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each team's run scheme in a season, by the first rule that its rates meet."""
    p, team, game, player = plays(spark, sf_dir), F.col("team"), F.col("game"), F.col("player")
    gap = F.when((team % 3 == 0) & (player % 2 == 0), "end").otherwise(_pick(("end", "tackle", "guard", None), (player + game) % 4))
    side = F.when((team % 4 > 0) & (game % 2 == 0), "left").otherwise(_pick(("left", "middle", "right"), game % 3))
    return T.run_schemes(p.select("team", "season", F.col("kind").alias("play_type"), gap.alias("run_gap"), side.alias("run_location"), F.when(F.col("play_no") < 7, F.col("success")).alias("shotgun"), (player % 5 == 0).cast("int").alias("no_huddle")))


_STATS = ("quality", "sacks", "pressures", "hurries", "tackles")


@query(f"""WITH {{plays}}, d AS (SELECT player, team, season, week, sum(success) AS sacks, count_if(kind = 'pass') AS pressures, count_if(yards > 30) AS hurries, count(*) AS tackles FROM plays GROUP BY ALL),
k AS (SELECT d.* FROM d LEFT JOIN part ON p_partkey = player AND player % 10 > 0 WHERE p_partkey IS NULL OR player % 6 NOT IN (0, 3)),
t AS (SELECT team, season, week, CAST(sum(sacks) AS DOUBLE) AS sacks, CAST(sum(pressures) AS DOUBLE) AS pressures, CAST(sum(hurries) AS DOUBLE) AS hurries, CAST(sum(tackles) AS DOUBLE) AS tackles FROM k GROUP BY ALL), q AS (SELECT *, 0.3 * sacks + 0.3 * pressures + 0.2 * hurries + 0.2 * tackles AS quality FROM t)
SELECT team, season, week, {", ".join(f"round(avg({c}) OVER w + 1e-9, 6) AS front7_{c}" for c in _STATS)} FROM q WINDOW w AS (PARTITION BY team, season ORDER BY week ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""")
def front_seven(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the front seven did in the three weeks before; players that the roster does not know count."""
    d = plays(spark, sf_dir).groupBy("player", "team", "season", "week").agg(F.sum("success").alias("sacks"), F.count_if(F.col("kind") == "pass").alias("pressures"), F.count_if(F.col("yards") > 30).alias("hurries"), F.count("*").alias("tackles"))
    key = F.col("p_partkey")
    position = table(spark, sf_dir, "part").where(key % 10 > 0).select(key.alias("player"), _pick(("CB", "DE", "DT", "S", "LB", "EDGE"), key % 6).alias("position"))
    roster = d.select("player", "team", "season").distinct().join(position, "player")
    out = T.front_seven(d, roster)
    return out.select(*T.TEAM_WEEK, *[fixed(f"front7_{c}").alias(f"front7_{c}") for c in _STATS])


_SUMS = {"exp_points": "exp_points", "over_expected": "points_over_expected", "exp_pass": "pass_exp_points", "exp_rush": "rush_exp_points", "exp_rec": "rec_exp_points", "exp_tds": "exp_tds"}
_EP = (*_SUMS, "tds_over_expected", "opportunity_hhi", "rush_share_hhi")
_FRAMES = {"roll3": "3 PRECEDING", "roll6": "6 PRECEDING", "std": "UNBOUNDED PRECEDING"}


@query(f"""WITH {{plays}}, p AS (SELECT player, team, season, week, player % 4 = 0 AS back, sum(yards) / 10 AS exp_points, sum(CASE WHEN kind = 'pass' THEN yards / 10 END) AS pass_exp_points, sum(CASE WHEN kind = 'run' THEN yards / 10 END) AS rush_exp_points, sum(CASE WHEN kind = 'other' THEN yards / 10 END) AS rec_exp_points, sum(epa) AS points_over_expected,
  count(*) / 10 AS exp_tds, sum(success) AS tds, CAST(count_if(kind = 'pass') AS DOUBLE) AS targets, CAST(count_if(kind = 'run') AS DOUBLE) AS carries FROM plays GROUP BY ALL),
t AS (SELECT team, season, week, {", ".join(f"coalesce(sum({c}), 0) AS {k}" for k, c in _SUMS.items())}, sum(tds) - sum(exp_tds) AS tds_over_expected, CASE WHEN sum(targets + carries) > 0 THEN sum((targets + carries) ** 2) / sum(targets + carries) ** 2 ELSE 0 END AS opportunity_hhi,
  CASE WHEN count_if(back) > 0 THEN CASE WHEN sum(carries) FILTER (back) > 0 THEN sum(carries ** 2) FILTER (back) / (sum(carries) FILTER (back)) ** 2 ELSE 0 END END AS rush_share_hhi FROM p GROUP BY ALL)
SELECT team, season, week, {", ".join(f"round({c} + 1e-9, 6) AS ep_{c}" for c in _EP)}, {", ".join(f"round(avg({c}) OVER (w ROWS BETWEEN {f} AND 1 PRECEDING) + 1e-9, 6) AS ep_{c}_{n}" for c in _EP for n, f in _FRAMES.items())} FROM t WINDOW w AS (PARTITION BY team, season ORDER BY week)""")
def expected_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine expected-points measures of a team's week, with their means of earlier weeks."""
    kind, tenth = F.col("kind"), F.col("yards") / 10
    part = lambda k: F.sum(F.when(kind == k, tenth))
    p = plays(spark, sf_dir).groupBy("player", "team", "season", "week").agg(
        (F.sum("yards") / 10).alias("exp_points"), part("pass").alias("pass_exp_points"), part("run").alias("rush_exp_points"), part("other").alias("rec_exp_points"), F.sum("epa").alias("points_over_expected"),
        (F.count("*") / 10).alias("exp_tds"), F.sum("success").alias("tds"), F.count_if(kind == "pass").cast("double").alias("targets"), F.count_if(kind == "run").cast("double").alias("carries"),
    )
    out = T.expected_points(p.withColumn("position", F.when(F.col("player") % 4 == 0, "RB").otherwise("WR")))
    return out.select(*T.TEAM_WEEK, *[fixed(c).alias(c) for c in out.columns[3:]])


_WEEKS = "k AS (SELECT player, season, week, avg(yards) / 10 AS separation, avg(epa) * 100 AS after_catch FROM plays GROUP BY ALL)"


def _weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plays(spark, sf_dir).groupBy("player", "season", "week").agg((F.avg("yards") / 10).alias("separation"), (F.avg("epa") * 100).alias("after_catch"))


@query(f"""WITH {{plays}}, {_WEEKS}, r AS (SELECT player, season, week, round(coalesce(avg(separation) OVER w, 0) * 0.5 + coalesce(avg(after_catch) OVER w, 0) * 0.3 + 1e-9, 3) AS quality FROM k WINDOW w AS (PARTITION BY player, season ORDER BY week ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
l AS (SELECT player, quality FROM r QUALIFY row_number() OVER (PARTITION BY player ORDER BY season DESC, week DESC) = 1), d AS (SELECT p_partkey AS player, p_retailprice / 100 AS points, coalesce(quality, 0) AS q FROM part LEFT JOIN l ON player = p_partkey),
f AS (SELECT *, least(greatest(1 + (q - (SELECT quantile_cont(q, 0.5) FROM d WHERE q <> 0)) * 0.02, 0.95), 1.08) AS factor FROM d)
SELECT player, round(points * factor + 1e-9, 2) AS points, round(factor + 1e-9, 4) AS factor FROM f""")
def quality_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projections times a factor of the latest quality against the median."""
    projections = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("player"), (F.col("p_retailprice") / 100).alias("points"))
    return T.with_quality_factor(projections, T.receiving_quality(_weeks(spark, sf_dir)))


@query(f"""WITH {{plays}}, {_WEEKS}, g AS (SELECT *, player % 4 AS position FROM k), h AS (SELECT position, season, week + unnest([1, 2, 3, 4]) AS week, separation FROM g), m AS (SELECT position, season, week, quantile_cont(separation, 0.5) AS group_median FROM h GROUP BY ALL),
r AS (SELECT g.player, g.season, g.week, avg(separation) OVER w AS recent_mean, group_median FROM g LEFT JOIN m USING (position, season, week) WINDOW w AS (PARTITION BY player, g.season ORDER BY g.week ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
SELECT player, season, week, round(recent_mean + 1e-9, 6) AS recent_mean, round(group_median + 1e-9, 6) AS group_median, round(CASE WHEN group_median <> 0 THEN recent_mean / group_median END + 1e-9, 6) AS ratio FROM r""")
def prior_median_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A player's last games against the median of all the position's four weeks before."""
    weeks = _weeks(spark, sf_dir).withColumn("position", F.col("player") % 4)
    out = T.to_prior_median(weeks, "separation", ("position",), 4)
    return out.select("player", "season", "week", *[fixed(c).alias(c) for c in ("recent_mean", "group_median", "ratio")])

"""Queries over lists of players on the field: orders as plays, their parts as the players of both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelag.functions.scalars import fixed
from tidelag.operators import participation as P
from tidelag.plans.inputs import games, query
from tidelag.sources.tables import table

_FIELD = """lists AS (SELECT l_orderkey AS game, list(CAST(l_partkey AS VARCHAR)) FILTER (l_linestatus = 'F') AS offense, list(CAST(l_partkey AS VARCHAR)) FILTER (l_linestatus <> 'F') AS defense, min(l_partkey) FILTER (l_linestatus = 'F') AS first_player FROM lineitem GROUP BY l_orderkey),
field AS (SELECT g.game, g.home AS posteam, g.away AS defteam, g.season, g.week, CAST(g.game % 3 > 0 AS INTEGER) AS qb_dropback, l.offense, l.defense, CASE WHEN g.game % 3 > 0 THEN CAST(l.first_player AS VARCHAR) END AS receiver,
  CAST(g.game % 5 < 3 AS BIGINT) AS complete, CASE WHEN g.game % 11 > 0 THEN g.game % 40 - 5 END AS air_yards, CASE WHEN g.game % 5 < 3 THEN g.game % 13 END AS yac, g.spread / 10 AS epa, CASE WHEN g.game % 17 > 0 THEN 4 + g.game % 6 END AS box,
  ['left', 'middle', 'right'][CAST(g.referee % 3 + 1 AS INTEGER)] AS location, g.home_score AS yards FROM games g JOIN lists l ON l.game = g.game)"""
_ROSTER = "roster AS (SELECT CAST(p_partkey AS VARCHAR) AS player_id, ['CB', 'DB', 'S', 'T', 'G', 'WR'][CAST(p_partkey % 6 + 1 AS INTEGER)] AS position FROM part WHERE p_partkey % 10 > 0)"


def field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plays with ;-separated lists of offence and defence, a receiver on dropbacks, and what came of them."""
    l, k = table(spark, sf_dir, "lineitem"), F.col("game")
    listed = lambda on: F.array_join(F.collect_list(F.when(on, F.col("l_partkey").cast("string"))), "; ")
    offense = F.col("l_linestatus") == "F"
    lists = l.groupBy(F.col("l_orderkey").alias("game")).agg(F.nullif(listed(offense), F.lit("")).alias("offense_players"), F.nullif(listed(~offense), F.lit("")).alias("defense_players"), F.min(F.when(offense, F.col("l_partkey"))).cast("string").alias("first_player"))
    return games(spark, sf_dir).join(lists, "game").select(
        "game", F.col("home").alias("posteam"), F.col("away").alias("defteam"), "season", "week", (k % 3 > 0).cast("int").alias("qb_dropback"), "offense_players", "defense_players", F.when(k % 3 > 0, F.col("first_player")).alias("receiver"),
        (k % 5 < 3).cast("long").alias("complete"), F.when(k % 11 > 0, k % 40 - 5).alias("air_yards"), F.when(k % 5 < 3, k % 13).alias("yac"), (F.col("spread") / 10).alias("epa"), F.when(k % 17 > 0, k % 6 + 4).alias("box"),
        F.element_at(F.array(*map(F.lit, ("left", "middle", "right"))), (F.col("referee") % 3 + 1).cast("int")).alias("location"), F.col("home_score").alias("yards"),
    )


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").where("p_partkey % 10 > 0")
    position = F.element_at(F.array(*map(F.lit, ("CB", "DB", "S", "T", "G", "WR"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    return p.select(F.col("p_partkey").cast("string").alias("player_id"), position.alias("position"), F.lit(2000).alias("season"))


_SLOPE = "CASE WHEN regr_count({0}, i) OVER {1} >= 3 THEN regr_slope({0}, i) OVER {1} END"


@query(f"""WITH {{games}}, {_FIELD}, b AS (SELECT * FROM field WHERE qb_dropback = 1 AND offense IS NOT NULL), t AS (SELECT posteam, season, week, count(*) AS n FROM b GROUP BY ALL),
o AS (SELECT player_id, posteam, season, week, count(*) AS own FROM (SELECT unnest(offense) AS player_id, posteam, season, week FROM b) GROUP BY ALL),
g AS (SELECT receiver AS player_id, season, week, count(*) AS targets FROM field WHERE receiver IS NOT NULL GROUP BY ALL),
r AS (SELECT o.*, t.n, o.own / t.n AS rate, coalesce(g.targets, 0) / o.own AS tprr, row_number() OVER (PARTITION BY o.player_id, o.season ORDER BY o.week, o.posteam) AS i FROM o JOIN t USING (posteam, season, week) LEFT JOIN g ON g.player_id = o.player_id AND g.season = o.season AND g.week = o.week),
m AS (SELECT *, CASE WHEN count(*) OVER f >= 2 THEN avg(rate) OVER f END AS trail, {_SLOPE.format("rate", "f")} AS slope, CASE WHEN count(*) OVER f >= 2 THEN avg(tprr) OVER f END AS tprr_trail, {_SLOPE.format("tprr", "f")} AS tprr_slope FROM r WINDOW f AS (PARTITION BY player_id, season ORDER BY week, posteam ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING))
SELECT player_id, season, week, posteam AS recent_team, CAST(own AS BIGINT) AS dropbacks_on_field, CAST(n AS BIGINT) AS team_dropbacks, round(rate + 1e-9, 6) AS route_rate, round(trail + 1e-9, 6) AS route_rate_trail4, round(trail - lag(trail) OVER (PARTITION BY player_id, season ORDER BY week, posteam) + 1e-9, 6) AS route_rate_delta, round(slope + 1e-9, 6) AS route_rate_slope,
  round(tprr + 1e-9, 6) AS tprr, round(tprr_trail + 1e-9, 6) AS tprr_trail4, round(tprr_slope + 1e-9, 6) AS tprr_trail4_slope, round(tprr_trail * slope + 1e-9, 6) AS tprr_x_route_slope FROM m""")
def route_participation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of dropbacks on the field, targets a route, and both trends."""
    plays = field(spark, sf_dir)
    targets = plays.where("receiver IS NOT NULL").groupBy(F.col("receiver").alias("player_id"), "season", "week").agg(F.count("*").alias("targets"))
    out = P.target_rates(P.route_participation(plays), targets)
    rates = ("route_rate", "route_rate_trail4", "route_rate_delta", "route_rate_slope", "tprr", "tprr_trail4", "tprr_trail4_slope", "tprr_x_route_slope")
    return out.select("player_id", "season", "week", "recent_team", "dropbacks_on_field", "team_dropbacks", *[fixed(c).alias(c) for c in rates])


@query(f"""WITH {{games}}, {_FIELD}, p AS (SELECT * FROM field WHERE receiver IS NOT NULL), t AS (SELECT posteam, defteam, season, week, count(*) AS team_targets FROM p GROUP BY ALL),
a AS (SELECT receiver, defteam, season, week, count(*) AS n, sum(complete) AS c, coalesce(sum(air_yards), 0) AS air, coalesce(sum(air_yards * complete), 0) AS done, coalesce(sum(yac), 0) AS yac, avg(epa) FILTER (box <= 6) AS light, avg(epa) FILTER (box >= 7) AS heavy, avg(complete) FILTER (air_yards < 5) AS short, count_if(location = 'middle') AS mid, avg(epa) FILTER (location = 'middle') AS mid_epa, max(posteam) AS posteam FROM p GROUP BY ALL)
SELECT receiver, defteam, season, week, round(n / team_targets + 1e-9, 6) AS wr_matchup_target_concentration, round(air / n + 1e-9, 6) AS wr_matchup_air_yards_per_target, round(done / n + 1e-9, 6) AS wr_matchup_completed_air_yards_per_target, round(CASE WHEN c > 0 THEN yac / c END + 1e-9, 6) AS wr_matchup_yac_per_catch,
  round(light + 1e-9, 6) AS wr_matchup_light_box_epa, round(heavy + 1e-9, 6) AS wr_matchup_heavy_box_epa, round(short + 1e-9, 6) AS wr_matchup_short_pass_completion_rate, round(mid / n + 1e-9, 6) AS wr_matchup_middle_target_rate, round(mid_epa + 1e-9, 6) AS wr_matchup_middle_epa FROM a JOIN t USING (posteam, defteam, season, week)""")
def receiver_matchups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine measures of receivers against defences, by week."""
    out = P.receiver_matchups(field(spark, sf_dir))
    return out.select(*[fixed(c).alias(c) if c.startswith("wr_") else F.col(c) for c in out.columns])


@query(f"""WITH {{games}}, {_FIELD}, {_ROSTER}, d AS (SELECT receiver, season, week, yards, unnest(defense) AS corner FROM field WHERE receiver IS NOT NULL),
p AS (SELECT receiver, corner, season, week, count(*) AS plays, sum(yards) AS yards FROM d JOIN roster ON player_id = corner WHERE position IN ('CB', 'DB') GROUP BY ALL)
SELECT receiver, corner, season, week, CAST(plays AS BIGINT) AS plays, CAST(yards AS BIGINT) AS yards, CAST(coalesce(sum(plays) OVER f, 0) AS BIGINT) AS plays_before, CAST(coalesce(sum(yards) OVER f, 0) AS BIGINT) AS yards_before FROM p WINDOW f AS (PARTITION BY receiver, corner ORDER BY season, week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def met_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receivers and the corner backs who were on the field with them, with what they had before."""
    return P.met_corners(field(spark, sf_dir), roster(spark, sf_dir))


@query(f"""WITH {{games}}, {_FIELD}, {_ROSTER}, e AS (SELECT game, unnest(offense) AS player_id FROM field), o AS (SELECT e.* , position FROM e JOIN roster USING (player_id) WHERE position IN ('T', 'G')),
c AS (SELECT CAST(p_partkey AS VARCHAR) AS player_id, ['LT', 'RG', 'WR', 'C'][CAST(p_partkey % 4 + 1 AS INTEGER)] AS place, p_partkey % 3 = 1 AS first FROM part WHERE p_partkey % 5 > 0),
l AS (SELECT o.game, o.player_id, coalesce(c.place, o.position) AS ol_label, coalesce(c.first, false) AS is_starter FROM o LEFT JOIN c ON c.player_id = o.player_id AND c.place <> 'WR')
SELECT player_id, ol_label, is_starter, CAST(count(*) AS BIGINT) AS plays FROM l GROUP BY ALL""")
def line_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and starters of the offensive line, and their plays."""
    k = F.col("p_partkey")
    place = F.element_at(F.array(*map(F.lit, ("LT", "RG", "WR", "C"))), (k % 4 + 1).cast("int"))
    depth = table(spark, sf_dir, "part").where("p_partkey % 5 > 0").select(k.alias("player_id"), place.alias("position"), (k % 3).alias("depth_team"), F.lit(2000).alias("season"))
    both = P.on_field(field(spark, sf_dir), {"offense_players": "offense", "defense_players": "defense"}, ["game"], roster(spark, sf_dir))
    return P.line_roles(both, depth).groupBy("player_id", "ol_label", "is_starter").agg(F.count("*").alias("plays"))

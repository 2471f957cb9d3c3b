"""Prospects likened to earlier ones of their position: comparisons, what came of them, and the graph of likenesses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelag.functions.scalars import fixed
from tidelag.operators import similarity as S
from tidelag.plans.inputs import plays, query
from tidelag.sources.tables import table


def _scaled(x: str, low: float, high: float) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN least(greatest(({x} - {low}) / ({high} - {low}), 0), 1) END"


_PROSPECTS = f"""n AS (SELECT p_partkey AS id, p_type AS block, 2000 + p_partkey * 7 % 20 AS season, p_partkey * 13 % 260 + 1 AS pick, p_partkey * 13 % 260 // 38 + 1 AS round, CASE WHEN p_partkey % 6 > 0 THEN CAST(150 + p_size * 4 AS DOUBLE) END AS wt,
  CASE WHEN p_partkey % 7 > 0 THEN CAST(4.2 AS DOUBLE) + (p_partkey * 11 % 131) / 100 END AS forty, CASE WHEN p_partkey % 5 > 0 THEN CAST(20 + p_partkey * 17 % 27 AS DOUBLE) END AS vertical, CASE WHEN p_partkey % 9 > 0 THEN CAST(90 + p_partkey * 19 % 51 AS DOUBLE) END AS broad_jump, CASE WHEN p_partkey % 8 > 0 THEN split_part(p_name, ' ', 2) END AS school FROM part),
z AS (SELECT id, block, season, coalesce({_scaled("pick", 1, 260)}, 0.5) AS p, coalesce({_scaled("round", 1, 7)}, 0.5) AS r, {", ".join(f"{_scaled(m, *r)} AS m{i}" for i, (m, r) in enumerate(S.MEASURES.items()))}, school, CASE WHEN length(school) <= 4 THEN 'short' WHEN length(school) = 5 THEN 'middle' END AS style FROM n)"""
_N = " + ".join(f"CAST(a.m{i} IS NOT NULL AND b.m{i} IS NOT NULL AS INTEGER)" for i in range(4))
_OFF = " + ".join(f"coalesce(abs(a.m{i} - b.m{i}), 0)" for i in range(4))
_SIMILARITY = f"""round(least(greatest(0.3 * (1 - (0.6 * abs(a.p - b.p) + 0.4 * abs(a.r - b.r))) + 0.5 * (CASE WHEN {_N} > 0 THEN 1 - ({_OFF}) / ({_N}) ELSE 0.5 END)
  + 0.2 * (CASE WHEN a.school = b.school THEN 1.0 WHEN a.style = b.style THEN 0.7 ELSE 0.3 END), 0), 1) + 1e-9, 6)"""
_COMPS = f"""{_PROSPECTS}, k AS (SELECT a.id AS player_id, b.id AS comp_player_id, {_SIMILARITY} AS similarity_score FROM z a JOIN z b ON a.block = b.block AND a.season > b.season QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY similarity_score DESC, b.id) <= 5),
w AS (SELECT player, season, week, sum(yards) / 5 AS points FROM plays GROUP BY ALL), s AS (SELECT player, season, avg(points) AS mean, sum(points) AS points, count(*) AS n FROM w GROUP BY ALL),
o AS (SELECT player, sum(points) / sum(n) AS ppg, max(mean) AS best, count(*) AS seasons FROM s GROUP BY player),
c AS (SELECT player_id, comp_player_id, similarity_score, ppg, best, coalesce(seasons, 0) AS seasons FROM k LEFT JOIN o ON player = comp_player_id)"""


def prospects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafted players with pick, round, measures (some unknown), school and its style."""
    k = F.col("p_partkey")
    school = F.when(k % 8 > 0, F.split_part(F.col("p_name"), F.lit(" "), F.lit(2)))
    d = table(spark, sf_dir, "part").select(
        k.alias("id"), F.col("p_type").alias("block"), (k * 7 % 20 + 2000).alias("season"), (k * 13 % 260 + 1).alias("pick"), (F.floor(k * 13 % 260 / 38) + 1).alias("round"), F.when(k % 6 > 0, F.col("p_size") * 4.0 + 150).alias("wt"),
        F.when(k % 7 > 0, k * 11 % 131 / 100 + 4.2).alias("forty"), F.when(k % 5 > 0, k * 17 % 27 + 20.0).alias("vertical"), F.when(k % 9 > 0, k * 19 % 51 + 90.0).alias("broad_jump"), school.alias("school"),
    )
    return d.withColumn("style", F.when(F.length("school") <= 4, "short").when(F.length("school") == 5, "middle"))


def _comps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.nearest_earlier(prospects(spark, sf_dir))
    # Whole yards add up exactly in any order, fifths of them do not: a mean of 5 points is not less than 5.
    weeks = plays(spark, sf_dir).groupBy("player", "season", "week").agg(F.sum("yards").alias("yards"))
    seasons = weeks.groupBy("player", "season").agg(F.sum("yards").alias("yards"), F.count("*").alias("n"), F.count("yards").alias("known"))
    points = lambda yards, n: F.try_divide(yards, 5 * n)
    outcomes = seasons.groupBy(F.col("player").alias("comp")).agg(points(F.sum("yards"), F.sum("n")).alias("comp_nfl_ppg"), F.max(points(F.col("yards"), F.col("known"))).alias("comp_best_season_ppg"), F.count("*").alias("seasons"))
    played = F.coalesce("seasons", F.lit(0)).alias("comp_seasons_played")
    return found.join(outcomes, "comp", "left").select(F.col("id").alias("player_id"), F.col("comp").alias("comp_player_id"), F.col("similarity").alias("similarity_score"), "comp_nfl_ppg", "comp_best_season_ppg", played)


@query(f"WITH {{plays}}, {_COMPS} SELECT player_id, comp_player_id, similarity_score, round(ppg + 1e-9, 6) AS comp_nfl_ppg, round(best + 1e-9, 6) AS comp_best_season_ppg, seasons AS comp_seasons_played FROM c")
def prospect_comps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five earlier prospects of the position that each is most like, and their careers."""
    return _comps(spark, sf_dir).withColumns({c: fixed(c) for c in ("comp_nfl_ppg", "comp_best_season_ppg")})


@query(f"""WITH {{plays}}, {_COMPS} SELECT player_id, round(quantile_cont(best, 0.75) + 1e-9, 6) AS prospect_comp_ceiling, round(quantile_cont(best, 0.25) + 1e-9, 6) AS prospect_comp_floor, round(median(best) + 1e-9, 6) AS prospect_comp_median,
  round(avg(CAST(ppg < 5 AS INTEGER)) + 1e-9, 6) AS prospect_comp_bust_rate, round(avg(seasons) + 1e-9, 6) AS years_to_breakout_comp FROM c WHERE best IS NOT NULL GROUP BY player_id""")
def prospect_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ceiling, floor, median, bust share and years of a prospect's comparisons."""
    f = S.comparison_features(_comps(spark, sf_dir))
    return f.select("player_id", *[fixed(c).alias(c) for c in f.columns[1:]])


@query(f"""WITH {_PROSPECTS}, c AS (SELECT min(id) AS id, count(*) AS n, block, p, r, m0, m1, m2, m3, school, style FROM z GROUP BY ALL), e AS (SELECT a.id AS a, b.id AS b, {_SIMILARITY} AS similarity, a.n AS a_size, b.n AS b_size FROM c a JOIN c b ON a.block = b.block AND a.id < b.id)
SELECT a, b, similarity, a_size, b_size FROM e WHERE similarity >= 0.94""")
def similarity_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a position's prospects that are at least 0.94 alike."""
    return S.similarity_graph(prospects(spark, sf_dir), 0.94)

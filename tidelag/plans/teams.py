"""Team-week metrics from plays, and lagged windows over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelag.functions import windows as W
from tidelag.functions.scalars import bucket, fixed, ratio
from tidelag.operators.joins import dealt
from tidelag.plans.inputs import plays, query

T3 = ("team", "season", "week")


def _mean_of(x: str, where) -> F.Column:
    return F.avg(F.when(where, F.col(x)))


@query("""WITH {plays}, t AS (SELECT team, season, week, avg(epa) AS epa, avg(CASE WHEN kind = 'pass' THEN epa END) AS pass_epa, avg(CASE WHEN kind = 'run' THEN epa END) AS run_epa, count(*) AS n FROM plays GROUP BY ALL)
SELECT team, season, week, n, round(epa + 1e-9, 6) AS epa, round(avg(epa) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) + 1e-9, 6) AS epa_roll3, round(avg(epa) OVER (w ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) + 1e-9, 6) AS epa_roll6,
  round(avg(epa) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1e-9, 6) AS epa_std, round(avg(pass_epa) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) + 1e-9, 6) AS pass_epa_roll3, round(avg(run_epa) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) + 1e-9, 6) AS run_epa_roll3
FROM t WINDOW w AS (PARTITION BY team, season ORDER BY week)""")
def team_split_lagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points added per play by team and week, with what the weeks before had."""
    t = plays(spark, sf_dir).groupBy(*T3).agg(
        F.avg("epa").alias("epa"), _mean_of("epa", F.col("kind") == "pass").alias("pass_epa"), _mean_of("epa", F.col("kind") == "run").alias("run_epa"), F.count("*").alias("n")
    )
    w = W.by(("team", "season"), ("week",))
    return t.select(
        *T3, "n", fixed("epa").alias("epa"), fixed(W.lagged_mean("epa", w, 3)).alias("epa_roll3"), fixed(W.lagged_mean("epa", w, 6)).alias("epa_roll6"),
        fixed(W.lagged_mean("epa", w)).alias("epa_std"), fixed(W.lagged_mean("pass_epa", w, 3)).alias("pass_epa_roll3"), fixed(W.lagged_mean("run_epa", w, 3)).alias("run_epa_roll3"),
    )


@query("""WITH {plays}, r AS (SELECT team AS club, 'off' AS side, season, week, epa, success FROM plays UNION ALL SELECT opp, 'def', season, week, epa, success FROM plays)
SELECT club, season, week, round(avg(CASE WHEN side = 'off' THEN epa END) + 1e-9, 6) AS off_epa, round(avg(CASE WHEN side = 'def' THEN epa END) + 1e-9, 6) AS def_epa,
  round(avg(CASE WHEN side = 'off' THEN success END) + 1e-9, 6) AS off_success, CAST(count_if(side = 'def') AS BIGINT) AS def_plays FROM r GROUP BY ALL""")
def role_union_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offence and defence of a club in one pass: each play counts for both roles, in place of outer joins."""
    p = plays(spark, sf_dir).select(F.explode(F.array(F.struct(F.col("team").alias("club"), F.lit("off").alias("side")), F.struct(F.col("opp").alias("club"), F.lit("def").alias("side")))).alias("r"), "season", "week", "epa", "success")
    off, den = F.col("r.side") == "off", F.col("r.side") == "def"
    return p.groupBy(F.col("r.club").alias("club"), "season", "week").agg(
        fixed(_mean_of("epa", off)).alias("off_epa"), fixed(_mean_of("epa", den)).alias("def_epa"), fixed(_mean_of("success", off)).alias("off_success"), F.count_if(den).alias("def_plays")
    )


@query("""WITH {plays}, b AS (SELECT team, season, success, CASE WHEN yards > 0 AND yards <= 19 THEN 'short' WHEN yards > 19 AND yards <= 39 THEN 'mid' WHEN yards > 39 AND yards <= 60 THEN 'long' END AS zone FROM plays)
SELECT team, season, round(avg(CASE WHEN zone = 'short' THEN success END) + 1e-9, 6) AS pct_short, round(avg(CASE WHEN zone = 'mid' THEN success END) + 1e-9, 6) AS pct_mid, round(avg(CASE WHEN zone = 'long' THEN success END) + 1e-9, 6) AS pct_long, CAST(count(zone) AS BIGINT) AS tries FROM b GROUP BY ALL""")
def bucket_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Success by distance bucket, one column each."""
    b = plays(spark, sf_dir).withColumn("zone", bucket("yards", (0, 19, 39, 60), ("short", "mid", "long")))
    return b.groupBy("team", "season").agg(*[fixed(_mean_of("success", F.col("zone") == z)).alias(f"pct_{z}") for z in ("short", "mid", "long")], F.count("zone").alias("tries"))


@query("""WITH {plays}, d AS (SELECT team, season, week, game, count(*) AS n, sum(yards) AS yards, max(success) AS scored FROM plays GROUP BY ALL)
SELECT team, season, week, count(*) AS drives, round(avg(n) + 1e-9, 6) AS plays_per_drive, round(avg(yards) + 1e-9, 4) AS yards_per_drive, round(avg(scored) + 1e-9, 6) AS scoring_rate FROM d GROUP BY ALL""")
def drive_two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drives from plays, then drives per team and week."""
    d = dealt(plays(spark, sf_dir), T3).groupBy(*T3, "game").agg(F.count("*").alias("n"), F.sum("yards").alias("yards"), F.max("success").alias("scored"))
    return d.groupBy(*T3).agg(F.count("*").alias("drives"), fixed(F.avg("n")).alias("plays_per_drive"), fixed(F.avg("yards"), 4).alias("yards_per_drive"), fixed(F.avg("scored")).alias("scoring_rate"))


@query("""WITH {plays}, d AS (SELECT team, season, week, game, max(yards) AS clock FROM plays GROUP BY ALL) SELECT team, season, week, round(sum(clock) + 1e-9, 4) AS possession FROM d GROUP BY ALL""")
def possession_max_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest clock of each drive, summed by team and week."""
    d = dealt(plays(spark, sf_dir), T3).groupBy(*T3, "game").agg(F.max("yards").alias("clock"))
    return d.groupBy(*T3).agg(fixed(F.sum("clock"), 4).alias("possession"))


@query("""WITH {plays}, s AS (SELECT team, season, epa, success, game % 2 = 0 AS home, team % 4 = opp % 4 AS division, value > 50000 AS ahead FROM plays)
SELECT team, season, round(avg(CASE WHEN home THEN epa END) + 1e-9, 6) AS home_epa, round(avg(CASE WHEN NOT home THEN epa END) + 1e-9, 6) AS away_epa, round(avg(CASE WHEN division THEN epa END) + 1e-9, 6) AS division_epa, round(avg(CASE WHEN NOT division THEN epa END) + 1e-9, 6) AS other_epa,
  round(avg(CASE WHEN ahead THEN epa END) + 1e-9, 6) AS ahead_epa, round(avg(CASE WHEN NOT ahead THEN epa END) + 1e-9, 6) AS behind_epa FROM s GROUP BY ALL""")
def conditional_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means by situation, all in one aggregation."""
    tests = {"home": F.col("game") % 2 == 0, "division": F.col("team") % 4 == F.col("opp") % 4, "ahead": F.col("value") > 50000}
    names = {"home": ("home", "away"), "division": ("division", "other"), "ahead": ("ahead", "behind")}
    means = [fixed(_mean_of("epa", c if i == 0 else ~c)).alias(f"{names[k][i]}_epa") for k, c in tests.items() for i in (0, 1)]
    return plays(spark, sf_dir).groupBy("team", "season").agg(*means)


@query("""WITH {plays}, f AS (SELECT team, opp, season, week, CASE WHEN yards < 5 THEN yards END AS foul FROM plays),
r AS (SELECT team AS club, season, week, foul AS committed, NULL::DOUBLE AS drawn FROM f UNION ALL SELECT opp, season, week, NULL, foul FROM f)
SELECT club, season, week, CAST(count(committed) AS BIGINT) AS fouls, round(coalesce(sum(committed), 0) + 1e-9, 4) AS foul_yards, CAST(count(drawn) AS BIGINT) AS drawn, round(coalesce(sum(drawn), 0) + 1e-9, 4) AS drawn_yards FROM r GROUP BY ALL""")
def fouls_both_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fouls committed and drawn; none counts 0."""
    none = F.lit(None).cast("double")
    f = plays(spark, sf_dir).withColumn("foul", F.when(F.col("yards") < 5, F.col("yards")))
    sides = F.array(F.struct(F.col("team").alias("club"), F.col("foul").alias("c"), none.alias("d")), F.struct(F.col("opp").alias("club"), none.alias("c"), F.col("foul").alias("d")))
    r = f.select(F.explode(sides).alias("r"), "season", "week").select("r.*", "season", "week")
    zero = lambda c: fixed(F.coalesce(F.sum(c), F.lit(0.0)), 4)
    return r.groupBy("club", "season", "week").agg(F.count("c").alias("fouls"), zero("c").alias("foul_yards"), F.count("d").alias("drawn"), zero("d").alias("drawn_yards"))


@query("""WITH {plays}, t AS (SELECT team, season, week, sum(CASE WHEN yards > 45 THEN 1 ELSE 0 END) AS lost, sum(CASE WHEN yards > 45 AND success = 1 THEN 1 ELSE 0 END) AS own FROM plays GROUP BY ALL),
spine AS (SELECT team, season, w.week FROM (SELECT DISTINCT team, season FROM plays), (SELECT unnest(range(1, 13)) AS week) w),
j AS (SELECT s.team, s.season, s.week, lost, own FROM spine s LEFT JOIN t USING (team, season, week)),
c AS (SELECT *, sum(own) OVER w AS own_before, sum(lost) OVER w AS lost_before FROM j WINDOW w AS (PARTITION BY team, season ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT team, season, week, CAST(coalesce(lost, 0) AS BIGINT) AS lost, round(CASE WHEN lost_before > 0 THEN own_before / lost_before END + 1e-9, 6) AS luck_rate,
  CAST(CASE WHEN lost_before > 0 AND own_before / lost_before > 0.6 THEN 1 WHEN lost_before > 0 AND own_before / lost_before < 0.4 THEN -1 ELSE 0 END AS BIGINT) AS luck FROM c""")
def turnover_tristate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full team-week spine; the share recovered before a week says lucky, unlucky or neither (0 for unknown)."""
    p = plays(spark, sf_dir)
    big = F.col("yards") > 45
    t = p.groupBy(*T3).agg(F.count_if(big).alias("lost"), F.count_if(big & (F.col("success") == 1)).alias("own"))
    spine = t.select("team", "season").distinct().withColumn("week", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(12).cast("long"))))
    w = W.by(("team", "season"), ("week",))
    c = spine.join(t, list(T3), "left").select(*T3, "lost", ratio(W.lagged_sum("own", w), W.lagged_sum("lost", w)).alias("r"))
    luck = F.when(F.col("r") > 0.6, 1).when(F.col("r") < 0.4, -1).otherwise(0).cast("long")
    return c.select(*T3, F.coalesce("lost", F.lit(0)).alias("lost"), fixed("r").alias("luck_rate"), luck.alias("luck"))


@query("""WITH {plays}, t AS (SELECT team, season, week, avg(epa) AS epa FROM plays GROUP BY ALL), g AS (SELECT DISTINCT team, opp, season, week FROM plays WHERE team <> opp),
o AS (SELECT g.team, g.season, g.week, avg(t.epa) AS opp_epa FROM g JOIN t ON g.opp = t.team AND g.season = t.season AND g.week = t.week GROUP BY ALL),
s AS (SELECT t.team, t.season, t.week, epa, avg(opp_epa) OVER (PARTITION BY t.team, t.season ORDER BY t.week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sos FROM t LEFT JOIN o USING (team, season, week))
SELECT team, season, week, round(sos + 1e-9, 6) AS sos, round(epa - sos + 1e-9, 6) AS adjusted, CASE WHEN sos IS NOT NULL THEN CAST(rank() OVER (PARTITION BY season, week, sos IS NULL ORDER BY round(sos + 1e-9, 6) DESC) AS BIGINT) END AS sos_rank FROM s""")
def sos_opponent_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strength of schedule: the mean of earlier opponents' same-week values, its rank, and the value against it."""
    p = plays(spark, sf_dir)
    t = p.groupBy(*T3).agg(F.avg("epa").alias("epa"))
    g = p.where("team <> opp").select(*T3, "opp").distinct()
    o = g.join(t.select(F.col("team").alias("opp"), "season", "week", F.col("epa").alias("e")), ["opp", "season", "week"]).groupBy(*T3).agg(F.avg("e").alias("opp_epa"))
    s = t.join(o, list(T3), "left").withColumn("raw", W.lagged_mean("opp_epa", W.by(("team", "season"), ("week",)))).withColumn("sos", fixed("raw"))
    rank = F.rank().over(Window.partitionBy("season", "week", F.col("sos").isNull()).orderBy(F.desc("sos")))
    return s.select(*T3, "sos", fixed(F.col("epa") - F.col("raw")).alias("adjusted"), F.when(F.col("sos").isNotNull(), rank.cast("long")).alias("sos_rank"))


@query("""WITH {plays}, t AS (SELECT team, season, week, avg(epa) AS epa FROM plays WHERE kind = 'pass' GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY team, season ORDER BY week) AS i FROM t)
SELECT a.team, a.season, a.week, round(sum(pow(0.5, (a.i - 1 - b.i) / 3.0) * b.epa) / sum(pow(0.5, (a.i - 1 - b.i) / 3.0)) + 1e-9, 6) AS epa_ewm3 FROM n a LEFT JOIN n b ON a.team = b.team AND a.season = b.season AND b.i < a.i GROUP BY ALL""")
def ewm_halflife3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponentially weighted mean of the weeks before, half-life of three rows."""
    t = plays(spark, sf_dir).where("kind = 'pass'").groupBy(*T3).agg(F.avg("epa").alias("epa"))
    return t.select(*T3, fixed(W.lagged_ewm("epa", W.by(("team", "season"), ("week",)), 3.0)).alias("epa_ewm3"))


@query("""WITH {plays}, t AS (SELECT team, season, week, avg(yards) AS y FROM plays GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY team, season ORDER BY week) AS i FROM t)
SELECT a.team, a.season, a.week, round(CASE WHEN count(b.y) >= 3 THEN regr_slope(b.y, b.i) END + 1e-9, 6) AS trend FROM n a LEFT JOIN n b ON a.team = b.team AND a.season = b.season AND b.i BETWEEN a.i - 4 AND a.i - 1 GROUP BY a.team, a.season, a.week""")
def rolling_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least-squares slope of the four weeks before, of three values or more."""
    t = plays(spark, sf_dir).groupBy(*T3).agg(F.avg("yards").alias("y"))
    return t.select(*T3, fixed(W.lagged_slope("y", W.by(("team", "season"), ("week",)), 4)).alias("trend"))


@query("""WITH {plays}, t AS (SELECT player, season, week, avg(CASE WHEN kind = 'pass' THEN yards END) AS y FROM plays GROUP BY ALL)
SELECT player, season, week, round(CASE WHEN count(y) OVER r3 >= 3 THEN avg(y) OVER r3 END + 1e-9, 6) AS roll3_min3, round(CASE WHEN count(y) OVER r4 >= 2 THEN avg(y) OVER r4 END + 1e-9, 6) AS roll4_min2, round(avg(y) OVER r3 + 1e-9, 6) AS roll3
FROM t WINDOW r3 AS (PARTITION BY player ORDER BY season, week ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), r4 AS (PARTITION BY player ORDER BY season, week ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)""")
def roll_min_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling means that ask for one, two or three values; a null in the frame counts for none."""
    t = plays(spark, sf_dir).groupBy("player", "season", "week").agg(_mean_of("yards", F.col("kind") == "pass").alias("y"))
    w = W.by(("player",), ("season", "week"))
    return t.select("player", "season", "week", *[fixed(W.lagged_mean("y", w, n, m)).alias(c) for c, n, m in (("roll3_min3", 3, 3), ("roll4_min2", 4, 2), ("roll3", 3, 1))])


@query("""WITH {plays}, t AS (SELECT team, season, week, avg(success) AS success_rate, avg(CASE WHEN kind = 'pass' THEN CASE WHEN yards > 40 THEN 1 ELSE 0 END END) AS explosive_pass, avg(CASE WHEN kind = 'run' THEN CASE WHEN yards > 40 THEN 1 ELSE 0 END END) AS explosive_run,
  avg(CASE WHEN kind = 'pass' THEN 1 ELSE 0 END) - avg(CASE WHEN success = 1 THEN 0.4 ELSE 0.3 END) AS proe, avg(CASE WHEN play_no = 4 THEN success END) AS fourth_rate FROM plays GROUP BY ALL)
SELECT team, season, week, round(success_rate + 1e-9, 6) AS success_rate, round(explosive_pass + 1e-9, 6) AS explosive_pass, round(explosive_run + 1e-9, 6) AS explosive_run, round(proe + 1e-9, 6) AS proe, round(fourth_rate + 1e-9, 6) AS fourth_rate FROM t""")
def rate_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Success, explosive, pass rate over expected and fourth-down rates in one aggregation."""
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    big, made = flag(F.col("yards") > 40), F.col("success") == 1
    over = F.avg(flag(F.col("kind") == "pass")) - F.avg(F.when(made, 0.4).otherwise(0.3))
    return plays(spark, sf_dir).groupBy(*T3).agg(
        fixed(F.avg("success")).alias("success_rate"), fixed(F.avg(F.when(F.col("kind") == "pass", big))).alias("explosive_pass"), fixed(F.avg(F.when(F.col("kind") == "run", big))).alias("explosive_run"),
        fixed(over).alias("proe"), fixed(_mean_of("success", F.col("play_no") == 4)).alias("fourth_rate"),
    )


@query("""WITH {plays}, p AS (SELECT team, season, player, sum(yards) AS y FROM plays GROUP BY ALL), s AS (SELECT *, y / sum(y) OVER (PARTITION BY team, season) AS share FROM p)
SELECT team, season, round(sum(share * share) + 1e-9, 6) AS hhi, round(max(share) + 1e-9, 6) AS top_share FROM s GROUP BY ALL""")
def hhi_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Herfindahl index of players' shares of a team's season."""
    p = plays(spark, sf_dir).groupBy("team", "season", "player").agg(F.sum("yards").alias("y")).withColumn("share", W.share("y", "team", "season"))
    return p.groupBy("team", "season").agg(fixed(F.sum(F.col("share") * F.col("share"))).alias("hhi"), fixed(F.max("share")).alias("top_share"))


@query("""WITH {plays} SELECT team, season, round(sum(epa * yards) / sum(yards) + 1e-9, 6) AS by_yards, round(sum(CASE WHEN kind = 'pass' THEN epa * value END) / sum(CASE WHEN kind = 'pass' THEN value END) + 1e-9, 6) AS pass_by_value FROM plays GROUP BY ALL""")
def weighted_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted means with the same mask on values and weights."""
    def mean(where, by: str):
        return ratio(F.sum(F.when(where, F.col("epa") * F.col(by))), F.sum(F.when(where, F.col(by))))

    return plays(spark, sf_dir).groupBy("team", "season").agg(fixed(mean(F.lit(True), "yards")).alias("by_yards"), fixed(mean(F.col("kind") == "pass", "value")).alias("pass_by_value"))


@query("""WITH {plays}, t AS (SELECT team, season, week, avg(yards) AS y FROM plays GROUP BY ALL)
SELECT team, season, week, round(avg(y) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) - avg(y) OVER (w ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) + 1e-9, 6) AS momentum, round(y - lag(y) OVER w + 1e-9, 6) AS change, round(lag(y) OVER w + 1e-9, 6) AS y_lag1
FROM t WINDOW w AS (PARTITION BY team, season ORDER BY week)""")
def momentum_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short window less long window, first difference and lag over one sort."""
    t = plays(spark, sf_dir).groupBy(*T3).agg(F.avg("yards").alias("y"))
    w = W.by(("team", "season"), ("week",))
    return t.select(*T3, fixed(W.lagged_mean("y", w, 3) - W.lagged_mean("y", w, 6)).alias("momentum"), fixed(F.col("y") - F.lag("y").over(w)).alias("change"), fixed(F.lag("y").over(w)).alias("y_lag1"))

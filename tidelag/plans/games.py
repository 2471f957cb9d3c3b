"""Game-level queries: sides, standings, streaks, as-of and range joins, travel, referees, pair correlation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelag.functions import windows as W
from tidelag.functions.scalars import bucket, clip, crosses, fixed, haversine_miles, implied_pair, ratio
from tidelag.operators.joins import as_of, both_sides, prior_range
from tidelag.plans.inputs import games, plays, query

T3 = ("team", "season", "week")
_SIDES = """s AS (SELECT game, season, week, day, home AS club, away AS rival, home_score AS own, away_score AS other, spread AS line, TRUE AS is_home FROM games UNION ALL SELECT game, season, week, day, away, home, away_score, home_score, -spread, FALSE FROM games)"""


def sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = games(spark, sf_dir).withColumn("back", -F.col("spread"))
    return both_sides(g, ("game", "season", "week", "day"), {"club": ("home", "away"), "rival": ("away", "home"), "own": ("home_score", "away_score"), "other": ("away_score", "home_score"), "line": ("spread", "back")})


@query("WITH {games}, " + _SIDES + """ SELECT club, season, is_home, CAST(count(*) AS BIGINT) AS games, round(avg(own) + 1e-9, 6) AS scored, round(avg(other) + 1e-9, 6) AS allowed, round(avg(line) + 1e-9, 6) AS line FROM s GROUP BY ALL""")
def home_away_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows per game, then venue splits."""
    return sides(spark, sf_dir).groupBy("club", "season", "is_home").agg(F.count("*").alias("games"), fixed(F.avg("own")).alias("scored"), fixed(F.avg("other")).alias("allowed"), fixed(F.avg("line")).alias("line"))


@query("WITH {games}, " + _SIDES + """, c AS (SELECT game, club, season, sum(CASE WHEN own > other THEN 1 ELSE 0 END) OVER w AS wins, sum(CASE WHEN own < other THEN 1 ELSE 0 END) OVER w AS losses, sum(CASE WHEN own = other THEN 1 ELSE 0 END) OVER w AS draws, week FROM s WINDOW w AS (PARTITION BY club, season ORDER BY day, game ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT game, club, CAST(coalesce(wins, 0) AS BIGINT) AS wins, CAST(coalesce(losses, 0) AS BIGINT) AS losses, CAST(coalesce(draws, 0) AS BIGINT) AS draws, CAST(max(coalesce(wins, 0)) OVER (PARTITION BY club % 4, season, week) - coalesce(wins, 0) AS BIGINT) AS behind FROM c""")
def standings_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wins, losses and draws before each game, and the distance to the division's leader of the week."""
    w = W.by(("club", "season"), ("day", "game"))
    count = lambda c: F.coalesce(W.lagged_sum(F.when(c, 1).otherwise(0), w), F.lit(0)).cast("long")
    o, r = F.col("own"), F.col("other")
    c = sides(spark, sf_dir).select("game", "club", "season", "week", count(o > r).alias("wins"), count(o < r).alias("losses"), count(o == r).alias("draws"))
    lead = F.max("wins").over(Window.partitionBy(F.col("club") % 4, "season", "week"))
    return c.select("game", "club", "wins", "losses", "draws", (lead - F.col("wins")).alias("behind"))


@query("WITH {games}, " + _SIDES + """, x AS (SELECT game, club, season, day, CASE WHEN own > other THEN 1 ELSE -1 END AS sgn FROM s), b AS (SELECT *, CASE WHEN lag(sgn) OVER w = sgn THEN 0 ELSE 1 END AS brk FROM x WINDOW w AS (PARTITION BY club, season ORDER BY day, game)),
i AS (SELECT *, sum(brk) OVER (PARTITION BY club, season ORDER BY day, game ROWS UNBOUNDED PRECEDING) AS isl FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY club, season, isl ORDER BY day, game) * sgn AS run FROM i)
SELECT game, club, CAST(coalesce(lag(run) OVER (PARTITION BY club, season ORDER BY day, game), 0) AS BIGINT) AS streak FROM r""")
def streak_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wins in a row, or minus losses in a row, before each game."""
    x = sides(spark, sf_dir).withColumn("sgn", F.when(F.col("own") > F.col("other"), 1).otherwise(-1))
    return W.signed_streak(x, "sgn", ("club", "season"), ("day", "game"), "streak").select("game", "club", F.col("streak").cast("long").alias("streak"))


@query("""WITH {games}, c AS (SELECT home AS club, day, game, referee % 3 AS coach FROM games), b AS (SELECT *, CASE WHEN lag(coach) OVER (PARTITION BY club ORDER BY day, game) = coach THEN 0 ELSE 1 END AS brk FROM c), i AS (SELECT *, sum(brk) OVER (PARTITION BY club ORDER BY day, game ROWS UNBOUNDED PRECEDING) AS term FROM b)
SELECT game, club, coach, CAST(term AS BIGINT) AS term, CAST(row_number() OVER (PARTITION BY club, term ORDER BY day, game) AS BIGINT) AS tenure, term > 1 AS changed FROM i""")
def tenure_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of unchanged coaches, games in the term, and a flag that stays once a change has come."""
    c = games(spark, sf_dir).select(F.col("home").alias("club"), "day", "game", (F.col("referee") % 3).alias("coach"))
    w = W.by(("club",), ("day", "game"))
    before = F.lag("coach").over(w)
    i = W.islands(c, before.isNull() | (before != F.col("coach")), w, "term")
    tenure = F.row_number().over(W.by(("club", "term"), ("day", "game"))).cast("long")
    return i.select("game", "club", "coach", "term", tenure.alias("tenure"), (F.col("term") > 1).alias("changed"))


@query("""WITH {games}, p AS (SELECT home AS club, referee, day, game, home_score - away_score AS margin FROM games)
SELECT game, club, referee, CAST(row_number() OVER w - 1 AS BIGINT) AS met_before, CAST(coalesce(sum(margin) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS margin_before FROM p WINDOW w AS (PARTITION BY club, referee ORDER BY day, game)""")
def pair_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair's earlier games and their sum."""
    w = W.by(("home", "referee"), ("day", "game"))
    before = F.coalesce(W.lagged_sum(F.col("home_score") - F.col("away_score"), w), F.lit(0))
    return games(spark, sf_dir).select("game", F.col("home").alias("club"), "referee", (F.row_number().over(w) - 1).cast("long").alias("met_before"), before.alias("margin_before"))


@query("""WITH {games}, e AS (SELECT CAST(ts AS DATE) AS day, user_id % 32 AS club, value FROM events), d AS (SELECT club, DATE '1995-01-01' + CAST((day - DATE '2024-01-01') * 200 + club * 10 AS INTEGER) AS day, max(value) AS v FROM e GROUP BY ALL)
SELECT g.game, g.home AS club, max_by(d.v, d.day) AS latest, max(d.day) AS seen FROM games g LEFT JOIN d ON g.home = d.club AND d.day < g.day GROUP BY ALL""")
def asof_pair_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest snapshot before each game, by one sort per club."""
    from tidelag.sources.tables import table

    e = table(spark, sf_dir, "events").select((F.col("user_id") % 32).alias("club"), F.to_date("ts").alias("d"), "value")
    shift = F.datediff("d", F.lit("2024-01-01")) * 200 + F.col("club").cast("int") * 10
    snaps = e.withColumn("day", F.date_add(F.lit("1995-01-01").cast("date"), shift)).groupBy("club", "day").agg(F.max("value").alias("latest")).withColumn("seen", F.col("day"))
    g = games(spark, sf_dir).select("game", F.col("home").alias("club"), "day")
    return as_of(g, snaps, ["club"], "day", "day", ["latest", "seen"]).drop("day")


@query("""WITH {plays}, u AS (SELECT team, season, week, sum(yards) AS y FROM plays WHERE kind = 'pass' GROUP BY ALL), t AS (SELECT DISTINCT team, season, week FROM plays)
SELECT t.team, t.season, t.week, round(avg(u.y) + 1e-9, 4) AS prior3, CAST(count(u.y) AS BIGINT) AS weeks FROM t LEFT JOIN u ON t.team = u.team AND t.season = u.season AND u.week >= t.week - 3 AND u.week < t.week GROUP BY ALL""")
def range_prior3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Use in the three calendar weeks before, by a range join."""
    p = plays(spark, sf_dir)
    u = p.where("kind = 'pass'").groupBy(*T3).agg(F.sum("yards").alias("y"))
    return prior_range(p.select(*T3).distinct(), u, ("team", "season"), "week", 3, [fixed(F.avg("y"), 4).alias("prior3"), F.count("y").alias("weeks")])


@query("""WITH {plays}, o AS (SELECT team, season, min(week) AS week FROM (SELECT team, season, week FROM plays GROUP BY ALL HAVING count(*) < 5) WHERE week > 3 GROUP BY ALL), u AS (SELECT team, season, week, player, sum(yards) AS y FROM plays GROUP BY ALL),
d AS (SELECT o.team, o.season, u.player, avg(CASE WHEN u.week >= o.week - 3 AND u.week < o.week THEN y END) AS before, avg(CASE WHEN u.week >= o.week AND u.week < o.week + 3 THEN y END) AS after FROM o JOIN u ON o.team = u.team AND o.season = u.season AND u.week BETWEEN o.week - 3 AND o.week + 2 GROUP BY ALL)
SELECT team, season, player, round(before + 1e-9, 4) AS before, round(after + 1e-9, 4) AS after, round(coalesce(after, 0) - coalesce(before, 0) + 1e-9, 4) AS absorbed FROM d""")
def before_after_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Use of players around an event week: mean before, mean after and difference, in one join."""
    p = plays(spark, sf_dir)
    o = p.groupBy(*T3).count().where("count < 5 AND week > 3").groupBy("team", "season").agg(F.min("week").alias("at"))
    u = p.groupBy(*T3, "player").agg(F.sum("yards").alias("y")).join(o, ["team", "season"]).where("week BETWEEN at - 3 AND at + 2")
    d = u.groupBy("team", "season", "player").agg(F.avg(F.when(F.col("week") < F.col("at"), F.col("y"))).alias("b"), F.avg(F.when(F.col("week") >= F.col("at"), F.col("y"))).alias("a"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return d.select("team", "season", "player", fixed("b", 4).alias("before"), fixed("a", 4).alias("after"), fixed(zero("a") - zero("b"), 4).alias("absorbed"))


@query("""WITH {plays}, k AS (SELECT team, season, week, player % 4 AS slot, sum(yards) AS y FROM plays GROUP BY ALL), p AS (SELECT a.team, a.slot AS a, b.slot AS b, a.season, a.y AS ya, b.y AS yb FROM k a JOIN k b ON a.team = b.team AND a.season = b.season AND a.week = b.week AND a.slot < b.slot),
r AS (SELECT team, a, b, count(*) FILTER (season < 1999) AS n_train, count(*) FILTER (season >= 1999) AS n_hold, corr(ya, yb) FILTER (season < 1999) AS rho_train, corr(ya, yb) FILTER (season >= 1999) AS rho_hold FROM p GROUP BY ALL)
SELECT team, a, b, CAST(n_train AS BIGINT) AS n_train, CAST(n_hold AS BIGINT) AS n_hold, round(rho_train + 1e-9, 6) AS rho_train, round(rho_hold + 1e-9, 6) AS rho_hold FROM r WHERE n_train >= 8 AND n_hold >= 4 AND rho_train * rho_hold > 0""")
def pair_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of pairs of slots of a team's week, kept where its sign holds on later seasons.

    A correlation of 0 has no sign; summed in floating point it would get one, another in each order of rows. Products of
    whole yards add up exactly, so whether it is 0 is told by them. Where one side never changes it is NaN, which is above 0 as in SQL.
    """
    k = plays(spark, sf_dir).groupBy(*T3, (F.col("player") % 4).alias("slot")).agg(F.sum("yards").alias("y"))
    a, b = (k.select(*T3, F.col("slot").alias(x), F.col("y").alias(f"y{x}")) for x in "ab")
    p = a.join(b, list(T3)).where("a < b")
    early = F.col("season") < 1999

    def corr(c: Column) -> Column:
        both = c & F.col("ya").isNotNull() & F.col("yb").isNotNull()
        a, b = F.when(both, F.col("ya")), F.when(both, F.col("yb"))
        products = F.sum(a * b)
        flat = (F.min(a) == F.max(a)) | (F.min(b) == F.max(b))
        zero = (F.count(a) * products == F.sum(a) * F.sum(b)) & (F.abs(products) < float("inf"))
        return F.when(flat, F.lit(float("nan"))).when(zero, F.lit(0.0)).otherwise(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))

    r = p.groupBy("team", "a", "b").agg(F.count_if(early).alias("n_train"), F.count_if(~early).alias("n_hold"), corr(early).alias("t"), corr(~early).alias("h"))
    return r.where("n_train >= 8 AND n_hold >= 4 AND t * h > 0").select("team", "a", "b", "n_train", "n_hold", fixed("t").alias("rho_train"), fixed("h").alias("rho_hold"))


@query("""WITH {plays}, q AS (SELECT team, opp, season, week, max(yards) AS best FROM plays GROUP BY ALL)
SELECT a.team, a.opp, a.season, a.week, a.best AS own_best, b.best AS rival_best FROM q a JOIN q b ON a.team = b.opp AND a.opp = b.team AND a.season = b.season AND a.week = b.week AND a.team < b.team""")
def game_stack_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides' best of one game, by a join on crossed keys."""
    q = plays(spark, sf_dir).groupBy("team", "opp", "season", "week").agg(F.max("yards").alias("best"))
    b = q.select(F.col("opp").alias("team"), F.col("team").alias("opp"), "season", "week", F.col("best").alias("rival_best"))
    return q.withColumnRenamed("best", "own_best").join(b, ["team", "opp", "season", "week"]).where("team < opp")


@query("""WITH {games} SELECT game, round(least(greatest(total / 2 + spread / 2, 5), 45) + 1e-9, 4) AS home_implied, round(least(greatest(total / 2 - spread / 2, 5), 45) + 1e-9, 4) AS away_implied, round(pow(least(greatest(least(greatest(total / 2 + spread / 2, 5), 45) / 23, 0.8), 1.2), 0.25) + 1e-9, 6) AS home_factor,
  CASE WHEN spread <= -7 THEN 'underdog' WHEN spread <= -3 THEN 'slight_underdog' WHEN spread < 3 THEN 'even' WHEN spread < 7 THEN 'slight_favourite' ELSE 'favourite' END AS script FROM games""")
def implied_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points implied by total and spread, the factor made of them, and the script class."""
    home, away = implied_pair(F.col("total"), F.col("spread"))
    s = F.col("spread")
    script = F.when(s <= -7, "underdog").when(s <= -3, "slight_underdog").when(s < 3, "even").when(s < 7, "slight_favourite").otherwise("favourite")
    return games(spark, sf_dir).select("game", fixed(home, 4).alias("home_implied"), fixed(away, 4).alias("away_implied"), fixed(F.pow(clip(home / 23, 0.8, 1.2), 0.25)).alias("home_factor"), script.alias("script"))


@query("""WITH {games}, c AS (SELECT game, away AS club, day, 25 + home * 0.7 AS la, -70 - home * 1.5 AS lo, 25 + away * 0.7 AS lb, -70 - away * 1.5 AS lp FROM games),
h AS (SELECT *, pow(sin(radians(lb - la) / 2), 2) + cos(radians(la)) * cos(radians(lb)) * pow(sin(radians(lp - lo) / 2), 2) AS a FROM c)
SELECT game, club, round(2 * 3958.8 * asin(sqrt(least(a, 1))) + 1e-9, 3) AS miles, CAST(day - lag(day) OVER (PARTITION BY club ORDER BY day, game) AS BIGINT) AS rest_days FROM h""")
def travel_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visitor's way in miles and its days of rest."""
    la, lo, lb, lp = 25 + F.col("home") * 0.7, -70 - F.col("home") * 1.5, 25 + F.col("away") * 0.7, -70 - F.col("away") * 1.5
    rest = F.datediff("day", F.lag("day").over(W.by(("away",), ("day", "game")))).cast("long")
    return games(spark, sf_dir).select("game", F.col("away").alias("club"), fixed(haversine_miles(lb, lp, la, lo), 3).alias("miles"), rest.alias("rest_days"))


@query("""WITH {games} SELECT game, referee, round(avg(home_score + away_score) OVER w + 1e-9, 6) AS total_before, CAST(count(*) OVER w AS BIGINT) AS games_before FROM games WINDOW w AS (PARTITION BY referee ORDER BY day, game ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def referee_expanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A referee's mean total over all earlier games."""
    w = W.by(("referee",), ("day", "game"))
    n = F.count("*").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return games(spark, sf_dir).select("game", "referee", fixed(W.lagged_mean(F.col("home_score") + F.col("away_score"), w)).alias("total_before"), n.alias("games_before"))


_KEYS = lambda a, b, numbers: " OR ".join(f"({a} < {k}) <> ({b} < {k})" for k in numbers)


@query("""WITH {games}, m AS (SELECT game, spread AS os, spread + (game % 9 - 4) * 0.5 AS cs, total AS ot, total + (game % 7 - 3) * 0.5 AS ct FROM games)
SELECT game, cs - os AS spread_shift, ct - ot AS total_shift, CAST(CASE WHEN cs = os THEN 0 WHEN abs(cs - os) <= 1 THEN 1 WHEN abs(cs - os) <= 2 THEN 2 ELSE 3 END AS DOUBLE) AS spread_magnitude, CAST(CASE WHEN ct = ot THEN 0 WHEN abs(ct - ot) <= 1 THEN 1 WHEN abs(ct - ot) <= 2 THEN 2 ELSE 3 END AS DOUBLE) AS total_magnitude, """ + f"{_KEYS('abs(os)', 'abs(cs)', (3, 7, 10))} AS crosses_key_spread, {_KEYS('ot', 'ct', (41, 44, 47))} AS crosses_key_total FROM m")
def line_move_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movement of spread and total from open to close, its size (0 for none), and whether it crossed a key number."""
    g = F.col("game")
    m = games(spark, sf_dir).select("game", F.col("spread").alias("os"), (F.col("spread") + (g % 9 - 4) * 0.5).alias("cs"), F.col("total").alias("ot"), (F.col("total") + (g % 7 - 3) * 0.5).alias("ct"))
    m = m.withColumns({"spread_shift": F.col("cs") - F.col("os"), "total_shift": F.col("ct") - F.col("ot")}).withColumns({"sa": F.abs("spread_shift"), "ta": F.abs("total_shift")})
    size = lambda c: bucket(c, (-0.001, 0, 1, 2, math.inf), ("0", "1", "2", "3")).cast("double")
    return m.select(
        "game", "spread_shift", "total_shift", size("sa").alias("spread_magnitude"), size("ta").alias("total_magnitude"),
        crosses(F.abs("os"), F.abs("cs"), (3, 7, 10)).alias("crosses_key_spread"), crosses(F.col("ot"), F.col("ct"), (41, 44, 47)).alias("crosses_key_total"),
    )


@query("""WITH {plays}, {games}, t AS (SELECT team, season, week, avg(epa) AS epa, avg(yards) AS yards FROM plays GROUP BY ALL)
SELECT g.game, round(h.epa - a.epa + 1e-9, 6) AS diff_epa, round(h.yards - a.yards + 1e-9, 4) AS diff_yards FROM games g LEFT JOIN t h ON g.home = h.team AND g.season = h.season AND g.week = h.week LEFT JOIN t a ON g.away = a.team AND g.season = a.season AND g.week = a.week""")
def game_differential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Home less away for every metric, by the columns' names."""
    t = plays(spark, sf_dir).groupBy(*T3).agg(F.avg("epa").alias("epa"), F.avg("yards").alias("yards"))
    metrics = {"epa": 6, "yards": 4}
    side = lambda x: t.select(F.col("team").alias(x), "season", "week", *[F.col(c).alias(f"{c}_{x}") for c in metrics])
    g = games(spark, sf_dir).select("game", "home", "away", "season", "week")
    j = g.join(side("home"), ["home", "season", "week"], "left").join(side("away"), ["away", "season", "week"], "left")
    return j.select("game", *[fixed(F.col(f"{c}_home") - F.col(f"{c}_away"), d).alias(f"diff_{c}") for c, d in metrics.items()])


@query("""WITH {plays}, a AS (SELECT opp, season, week, sum(yards) AS y, count(*) AS n FROM plays WHERE kind = 'run' GROUP BY ALL), p AS (SELECT opp, season, sum(y) AS y, sum(n) AS n FROM a GROUP BY ALL), q AS (SELECT opp, season, sum(y) OVER w / sum(n) OVER w AS before FROM p WINDOW w AS (PARTITION BY opp ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT a.opp, a.season, a.week, round(coalesce(sum(y) OVER w / sum(n) OVER w, q.before) + 1e-9, 6) AS trailing FROM a LEFT JOIN q USING (opp, season) WINDOW w AS (PARTITION BY a.opp, a.season ORDER BY a.week RANGE BETWEEN 4 PRECEDING AND 1 PRECEDING)""")
def calendar_ratio_of_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratio of sums over the four calendar weeks before; all earlier seasons where there are none."""
    a = plays(spark, sf_dir).where("kind = 'run'").groupBy("opp", "season", "week").agg(F.sum("yards").alias("y"), F.count("*").alias("n"))
    p = a.groupBy("opp", "season").agg(F.sum("y").alias("y"), F.sum("n").alias("n"))
    s = W.by(("opp",), ("season",))
    q = p.select("opp", "season", ratio(W.lagged_sum("y", s), W.lagged_sum("n", s)).alias("before"))
    w = W.by(("opp", "season"), ("week",))
    return a.join(q, ["opp", "season"], "left").select("opp", "season", "week", fixed(F.coalesce(ratio(W.calendar_sum("y", w, 4), W.calendar_sum("n", w, 4)), F.col("before"))).alias("trailing"))


@query("""WITH {plays}, t AS (SELECT team, season, week, avg(yards) AS y FROM plays WHERE kind = 'pass' GROUP BY ALL)
SELECT team, season, week, round(avg(y) OVER (PARTITION BY team, season ORDER BY week RANGE BETWEEN 2 PRECEDING AND 1 PRECEDING) - avg(y) OVER (PARTITION BY team, season ORDER BY week RANGE BETWEEN 6 PRECEDING AND 3 PRECEDING) + 1e-9, 6) AS trend,
  coalesce(avg(y) OVER (PARTITION BY team, season ORDER BY week RANGE BETWEEN 2 PRECEDING AND 1 PRECEDING) < 0.7 * avg(y) OVER (PARTITION BY team, season ORDER BY week RANGE BETWEEN 6 PRECEDING AND 3 PRECEDING), FALSE) AS collapsed FROM t""")
def recent_vs_prior_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the last two weeks less that of the four before, by calendar, and whether it fell by 30%."""
    t = plays(spark, sf_dir).where("kind = 'pass'").groupBy(*T3).agg(F.avg("yards").alias("y"))
    w = W.by(("team", "season"), ("week",))
    near, far = (F.avg("y").over(w.rangeBetween(*r)) for r in ((-2, -1), (-6, -3)))
    return t.select(*T3, fixed(near - far).alias("trend"), F.coalesce(near < 0.7 * far, F.lit(False)).alias("collapsed"))

"""Adjustments of projections, draft moments, cumulative accuracy and the feature spine that many tables join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelag.functions import windows as W
from tidelag.functions.scalars import clip, correlation, fixed
from tidelag.operators.joins import star
from tidelag.plans.inputs import plays, query
from tidelag.plans.rankings import boards
from tidelag.sources.tables import table

# Share of the expected rate in a touchdown count, by position.
TD_WEIGHT = {"QB": 0.75, "RB": 1.0, "WR": 0.75, "TE": 0.5}
# Touchdowns a yard, by position and the kind of yards.
TD_RATES = {
    "QB": {"passing": 0.00626, "rushing": 0.01048},
    "RB": {"rushing": 0.00741, "receiving": 0.00501},
    "WR": {"receiving": 0.00609},
    "TE": {"receiving": 0.00760},
}
# Multipliers of injury reports; any other is 0.85, no report 1.
INJURY = {"Active": 1.0, "Questionable": 0.85, "Doubtful": 0.50, "Out": 0.0, "Injured Reserve": 0.0, "IR": 0.0, "Physically Unable to Perform": 0.0, "PUP": 0.0, "Suspension": 0.0}
# A starter's line a game, by position, and the share of it that a role gets.
STARTER_LINES = {
    "QB": {"passing_yards": 230.0, "passing_tds": 1.4, "interceptions": 0.8, "rushing_yards": 15.0, "rushing_tds": 0.1},
    "RB": {"rushing_yards": 55.0, "rushing_tds": 0.4, "receptions": 3.0, "receiving_yards": 22.0, "receiving_tds": 0.1, "carries": 12.0},
    "WR": {"receiving_yards": 60.0, "receiving_tds": 0.4, "receptions": 4.5, "targets": 6.5},
    "TE": {"receiving_yards": 40.0, "receiving_tds": 0.3, "receptions": 3.0, "targets": 4.5},
}
ROLE_SHARE = {"starter": 1.00, "backup": 0.40, "unknown": 0.25}
STATS = sorted({stat for line in STARTER_LINES.values() for stat in line})
# Other codes of teams and the codes that they stand for.
TEAM_ALIASES = {"KAN": "KC", "LAR": "LA", "LVR": "LV", "NOR": "NO", "NWE": "NE", "SFO": "SF", "TAM": "TB", "JAC": "JAX", "GNB": "GB"}
# First and last week, least consensus and least gap of rank correlations of the grading population.
GRADED_WEEKS, LEAST_CONSENSUS, LEAST_RANK_GAP, LEAST_RANKED = (3, 18), 5.0, -0.01, 10
# Weights by week of draft position, of the season before, and of props by position.
DRAFT_WEIGHT = {1: 0.5, 2: 0.45, 3: 0.4, 4: 0.3, 5: 0.2, 6: 0.1}
SEASON_WEIGHT = {3: 0.4, 4: 0.3, 5: 0.2, 6: 0.1}
PROPS_WEIGHT = {"RB": 0.5, "WR": 0.3}
LEAST_GAMES = 6

_MEN = """m AS (SELECT p_partkey AS player, ['QB', 'RB', 'WR', 'TE'][p_partkey % 4 + 1] AS position, p_size AS size, p_retailprice / 50 AS points, p_partkey % 40 AS rank_, p_partkey % 8 AS week, p_partkey % 11 AS games FROM part)"""


def men(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    position = F.get(F.array(*map(F.lit, ("QB", "RB", "WR", "TE"))), (k % 4).cast("int"))
    return table(spark, sf_dir, "part").select(k.alias("player"), position.alias("position"), F.col("p_size").alias("size"), (F.col("p_retailprice") / 50).alias("points"), (k % 40).alias("rank_"), (k % 8).alias("week"), (k % 11).alias("games"))


def chosen(key, values: dict, other: float):
    """The value of a key from a small fixed table."""
    return reduce(lambda c, kv: F.when(key == kv[0], F.lit(float(kv[1]))).otherwise(c), values.items(), F.lit(float(other)))


def _case(key: str, values: dict, other: float) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {k!r} THEN {float(v)}" for k, v in values.items()) + f" ELSE {float(other)} END"


_REPORTS = ("Active", "Questionable", "Doubtful", "Out", "Injured Reserve", "IR", "Physically Unable to Perform", "PUP", "Suspension", "Unknown", None)
_KINDS = {"passing": ("size * 5 - 20", "size % 5 * 0.3"), "rushing": ("rank_ * 2 - 5", "rank_ % 4 * 0.25"), "receiving": ("points * 2", "games % 3 * 0.4")}


def drawn_to_rate(kind: str, position: F.Column, yards: F.Column, touchdowns: F.Column) -> F.Column:
    """Touchdowns drawn to the position's own rate for these yards, none for negative ones; untouched where it has no rate."""
    rate = chosen(position, {p: r[kind] for p, r in TD_RATES.items() if kind in r}, 0)
    w = F.when(rate > 0, chosen(position, TD_WEIGHT, 0)).otherwise(0.0)
    return fixed((1 - w) * touchdowns + w * F.greatest(yards, F.lit(0.0)) * rate, 3)


def _td_sql(kind: str) -> str:
    yards, tds = _KINDS[kind]
    cases = " ".join(f"WHEN '{p}' THEN (1 - {TD_WEIGHT[p]}) * ({tds}) + {TD_WEIGHT[p]} * greatest({yards}, 0) * {r[kind]}" for p, r in TD_RATES.items() if kind in r)
    return f"round(CAST(CASE position {cases} ELSE {tds} END AS DOUBLE) + 1e-9, 3) AS {kind}_tds"


@query(f"WITH {_MEN}, s AS (SELECT *, [{', '.join('NULL' if r is None else repr(r) for r in _REPORTS)}][size % 11 + 1] AS report FROM m)" + f"""
SELECT player, round(greatest(least(1.15 - (CASE WHEN rank_ = 0 THEN 16 ELSE rank_ END - 1) * 0.30 / 31, 1.25), 0.75) + 1e-9, 6) AS matchup, report, CASE WHEN report IS NULL THEN 1.0 ELSE {_case('report', INJURY, 0.85)} END AS injury, {', '.join(map(_td_sql, _KINDS))} FROM s""")
def projection_multipliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matchup by the opponent's rank (16 where it is missing), injury report, and touchdowns drawn to each yardage's own rate."""
    m = men(spark, sf_dir)
    rank = F.when(F.col("rank_") == 0, 16).otherwise(F.col("rank_"))
    m = m.withColumn("report", F.get(F.array(*map(F.lit, _REPORTS)), (F.col("size") % 11).cast("int")))
    injury = F.when(F.col("report").isNull(), 1.0).otherwise(chosen(F.col("report"), INJURY, 0.85))
    touchdowns = [drawn_to_rate(k, F.col("position"), F.expr(yards), F.expr(tds)).alias(f"{k}_tds") for k, (yards, tds) in _KINDS.items()]
    return m.select("player", fixed(clip(1.15 - (rank - 1) * 0.30 / 31, 0.75, 1.25)).alias("matchup"), "report", injury.alias("injury"), *touchdowns)


def role_of(snaps: F.Column, share: F.Column) -> F.Column:
    """starter above 0.60 of the snaps, backup from 0.30 on; without snaps backup above 0.15 of the targets; else unknown."""
    return F.when(snaps.isNull(), F.when(share > 0.15, "backup").otherwise("unknown")).when(snaps > 0.60, "starter").when(snaps >= 0.30, "backup").otherwise("unknown")


@query(f"WITH {_MEN}, r AS (SELECT *, CASE WHEN size % 3 = 0 THEN CASE WHEN rank_ / 100.0 > 0.15 THEN 'backup' ELSE 'unknown' END WHEN size / 50.0 > 0.60 THEN 'starter' WHEN size / 50.0 >= 0.30 THEN 'backup' ELSE 'unknown' END AS role FROM m)" + f"""
SELECT player, role, {', '.join(f"round(CASE position " + " ".join(f"WHEN '{p}' THEN {l[stat]}" for p, l in STARTER_LINES.items() if stat in l) + f" END * {_case('role', ROLE_SHARE, 0)} + 1e-9, 4) AS {stat}" for stat in STATS)} FROM r""")
def rookie_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The position's starter line times the share of the role, for each stat that the position has."""
    m = men(spark, sf_dir)
    m = m.withColumn("role", role_of(F.when(F.col("size") % 3 != 0, F.col("size") / 50.0), F.col("rank_") / 100.0))
    share = chosen(F.col("role"), ROLE_SHARE, 0)

    def filled(stat: str) -> F.Column:
        line = {p: l[stat] for p, l in STARTER_LINES.items() if stat in l}
        return fixed(F.when(F.col("position").isin(*line), chosen(F.col("position"), line, 0)) * share, 4).alias(stat)

    return m.select("player", "role", *map(filled, STATS))


@query(f"WITH {_MEN}, w AS (SELECT *, {_case('week', DRAFT_WEIGHT, 0)} AS d, CASE WHEN games >= {LEAST_GAMES} THEN {_case('week', SEASON_WEIGHT, 0)} ELSE 0 END AS s, CASE WHEN size > 10 THEN {_case('position', PROPS_WEIGHT, 0)} ELSE 0 END AS p FROM m), a AS (SELECT *, (1 - d) * points + d * rank_ AS x FROM w), b AS (SELECT *, (1 - s) * x + s * size AS y FROM a)" + """
SELECT player, round(x + 1e-9, 4) AS by_draft, round(y + 1e-9, 4) AS by_season, round((1 - p) * y + p * size * 2 + 1e-9, 4) AS by_props FROM b""")
def early_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Early weeks lean on draft position, then on the season before if it has enough games, then on props where the core market is there."""
    week, position, size = F.col("week"), F.col("position"), F.col("size")
    d = chosen(week, DRAFT_WEIGHT, 0)
    s = F.when(F.col("games") >= LEAST_GAMES, chosen(week, SEASON_WEIGHT, 0)).otherwise(0.0)
    p = F.when(size > 10, chosen(position, PROPS_WEIGHT, 0)).otherwise(0.0)
    m = men(spark, sf_dir).withColumn("x", (1 - d) * F.col("points") + d * F.col("rank_"))
    m = m.withColumn("y", (1 - s) * F.col("x") + s * size)
    return m.select("player", fixed("x", 4).alias("by_draft"), fixed("y", 4).alias("by_season"), fixed((1 - p) * F.col("y") + p * size * 2, 4).alias("by_props"))


@query("""WITH k AS (SELECT l_suppkey AS team, count_if(l_linestatus = 'O' AND l_quantity <= 49) AS made, count_if(l_linestatus = 'O' AND l_quantity > 49) AS long, count_if(l_linestatus <> 'O' AND l_returnflag = 'R') AS missed, count_if(l_linestatus <> 'O' AND l_returnflag = 'A') AS xp, count_if(l_linestatus <> 'O' AND l_returnflag = 'N') AS missed_xp FROM lineitem GROUP BY ALL)
SELECT team, CAST(3 * made + 5 * long + xp - missed - missed_xp AS BIGINT) AS points FROM k""")
def kicker_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3 for a field goal, 5 for a long one, 1 for an extra point, 1 off for each miss."""
    good, flag = F.col("l_linestatus") == "O", F.col("l_returnflag")
    worth = F.when(good & (F.col("l_quantity") > 49), 5).when(good, 3).when(flag == "A", 1).otherwise(-1)
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("team")).agg(F.sum(worth).alias("points"))


@query("""WITH p AS (SELECT p_partkey AS player, p_partkey % 97 + 1 AS pick, p_size * 2 AS adp, p_retailprice AS vorp FROM part)
SELECT player, CASE WHEN pick - adp >= 10 THEN 'steal' WHEN pick - adp <= -10 THEN 'reach' END AS moment, CAST(CASE WHEN pick - adp >= 10 OR pick - adp <= -10 THEN pick - adp END AS BIGINT) AS gap FROM p""")
def pick_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picks ten or more places after their average position are steals, as many before it reaches."""
    gap = F.col("p_partkey") % 97 + 1 - F.col("p_size") * 2
    moment = F.when(gap >= 10, "steal").when(gap <= -10, "reach")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("player"), moment.alias("moment"), F.when(moment.isNotNull(), gap.cast("long")).alias("gap"))


@query("""WITH p AS (SELECT p_partkey % 4 AS room, p_partkey AS player, p_retailprice + p_partkey * 37 % 101 AS vorp, p_size AS model_rank, p_partkey % 60 AS taken FROM part), n AS (SELECT room, count_if(taken >= 10) + 1 AS clock FROM p GROUP BY room), b AS (SELECT room, max_by(player, {'v': vorp, 'p': -player}) AS player, max_by(model_rank, {'v': vorp, 'p': -player}) AS model_rank FROM p WHERE taken < 10 GROUP BY room)
SELECT room, player, model_rank, CAST(clock AS BIGINT) AS clock FROM b JOIN n USING (room) WHERE model_rank + 12 <= clock""")
def value_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rooms whose best player that is left ranks twelve places or more before the pick on the clock."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select((k % 4).alias("room"), k.alias("player"), (F.col("p_retailprice") + k * 37 % 101).alias("vorp"), F.col("p_size").alias("model_rank"), (k % 60 >= 10).alias("gone"))
    best = F.max(F.when(~F.col("gone"), F.struct("vorp", (-F.col("player")).alias("p"), "model_rank"))).alias("b")
    r = p.groupBy("room").agg(best, (F.count_if("gone") + 1).alias("clock"))
    return r.where(F.col("b.model_rank") + 12 <= F.col("clock")).select("room", (-F.col("b.p")).alias("player"), F.col("b.model_rank").alias("model_rank"), "clock")


_CODES = (*TEAM_ALIASES, "KC", " jac ", "sfo", None)


def canonical_team(code: F.Column) -> F.Column:
    """The one code of a team: trimmed, upper case, aliases resolved; empty for null."""
    plain = F.upper(F.trim(F.coalesce(code, F.lit(""))))
    return reduce(lambda out, pair: F.when(plain == pair[0], F.lit(pair[1])).otherwise(out), TEAM_ALIASES.items(), plain)


_SQL_CODE = "upper(trim(coalesce([" + ", ".join("NULL" if c is None else f"'{c}'" for c in _CODES) + f"][p_partkey % {len(_CODES)} + 1], '')))"


@query(f"""SELECT p_partkey AS player, round(list_aggregate([CAST(p_size AS DOUBLE), p_retailprice / 100, CAST(p_partkey % 30 AS DOUBLE)], 'stddev_samp') + 1e-9, 6) AS volatility, regexp_replace('WR' || CAST(p_partkey % 13 AS VARCHAR), '[0-9]+$', '') AS position,
  CASE {_SQL_CODE} {' '.join(f"WHEN '{a}' THEN '{c}'" for a, c in TEAM_ALIASES.items())} ELSE {_SQL_CODE} END AS team FROM part""")
def row_spread_and_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard deviation across a row's columns, a depth label without its number, and a team's one code."""
    columns = F.array(F.col("p_size").cast("double"), F.col("p_retailprice") / 100, (F.col("p_partkey") % 30).cast("double"))
    mean = F.aggregate(columns, F.lit(0.0), lambda a, x: a + x) / F.size(columns)
    spread = F.sqrt(F.aggregate(columns, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / (F.size(columns) - 1))
    label = F.regexp_replace(F.concat(F.lit("WR"), (F.col("p_partkey") % 13).cast("string")), "[0-9]+$", "")
    code = F.get(F.array(*map(F.lit, _CODES)), (F.col("p_partkey") % len(_CODES)).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("player"), fixed(spread).alias("volatility"), label.alias("position"), canonical_team(code).alias("team"))


def cumulative_accuracy(matched: DataFrame, positions: tuple[str, ...]) -> DataFrame:
    """season, week, position, n, weeks, mae, rival_mae, gap, rank_gap, gate: each season's table up to each of its weeks, and an OVERALL row.

    matched: season, week, position, ours, theirs (consensus), actual. Rows count in the graded weeks, with a consensus of
    LEAST_CONSENSUS at least, at one of the positions; weeks counts all graded weeks with any row. rank_gap is ours less theirs of the mean of
    weekly rank correlations with what happened, of weeks with LEAST_RANKED rows. The gate is one for the whole table: no larger error
    overall, and no position whose rank_gap is below LEAST_RANK_GAP or unknown. Equal rows of a week are counted once and
    ranked with their number; rows are aggregated by week first, so what accumulates is a row a position and week.
    """
    graded = matched.where(F.col("week").between(*GRADED_WEEKS))
    rows = graded.where((F.col("theirs") >= LEAST_CONSENSUS) & F.col("position").isin(*positions))
    key = ["season", "week", "position"]
    each = rows.groupBy(*key, "ours", "theirs", "actual").agg(F.count("*").alias("times"))
    r = W.with_rank_averages(each, key, {c: f"r_{c}" for c in ("ours", "theirs", "actual")}, "times")
    total = lambda c: F.sum(F.col("times") * c)
    rho = lambda c: F.when(F.sum("times") >= LEAST_RANKED, correlation(f"r_{c}", "r_actual", "times")).alias(f"rho_{c}")
    weekly = r.groupBy(*key).agg(F.sum("times").alias("n"), total(F.abs(F.col("ours") - F.col("actual"))).alias("e"), total(F.abs(F.col("theirs") - F.col("actual"))).alias("f"), rho("ours"), rho("theirs"))
    spine = graded.select("season", "week").distinct().withColumn("position", F.explode(F.array(*map(F.lit, positions))))
    w = Window.partitionBy("season", "position").orderBy("week").rowsBetween(Window.unboundedPreceding, 0)
    known = lambda c: F.nanvl(F.col(c), F.lit(None).cast("double"))
    to_date = spine.join(weekly, key, "left").select(*key, *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(c) for c in ("n", "e", "f")], (F.avg(known("rho_ours")).over(w) - F.avg(known("rho_theirs")).over(w)).alias("rank_gap"), F.row_number().over(w).cast("long").alias("weeks")).where("n > 0")
    overall = to_date.groupBy("season", "week").agg(F.sum("n").alias("n"), F.sum("e").alias("e"), F.sum("f").alias("f"), F.max("weeks").alias("weeks"), F.bool_and(F.coalesce(F.col("rank_gap") >= LEAST_RANK_GAP, F.lit(False))).alias("ordered"))
    gates = overall.select("season", "week", ((F.col("e") <= F.col("f")) & F.col("ordered")).alias("gate"))
    table_ = to_date.unionByName(overall.select("season", "week", F.lit("OVERALL").alias("position"), "n", "e", "f", F.lit(None).cast("double").alias("rank_gap"), "weeks"))
    return table_.join(gates, ["season", "week"]).select(*key, "n", "weeks", (F.col("e") / F.col("n")).alias("mae"), (F.col("f") / F.col("n")).alias("rival_mae"), ((F.col("e") - F.col("f")) / F.col("n")).alias("gap"), "rank_gap", "gate")


@query("""WITH m AS (SELECT ['QB', 'RB', 'WR', 'TE', 'K'][CAST(l_suppkey % 5 + 1 AS INTEGER)] AS position, CAST(year(l_shipdate) AS BIGINT) AS season, CAST(month(l_shipdate) AS BIGINT) AS week, l_quantity * 0.6 + l_partkey % 23 AS ours, l_quantity * 0.4 + l_partkey % 11 AS theirs, l_quantity AS actual FROM lineitem),
g AS (SELECT * FROM m WHERE week BETWEEN 3 AND 18), f AS (SELECT * FROM g WHERE theirs >= 5 AND position IN ('QB', 'RB', 'WR', 'TE')),
r AS (SELECT *, rank() OVER (PARTITION BY season, week, position ORDER BY ours) + (count(*) OVER (PARTITION BY season, week, position, ours) - 1) / 2 AS ro, rank() OVER (PARTITION BY season, week, position ORDER BY theirs) + (count(*) OVER (PARTITION BY season, week, position, theirs) - 1) / 2 AS rt, rank() OVER (PARTITION BY season, week, position ORDER BY actual) + (count(*) OVER (PARTITION BY season, week, position, actual) - 1) / 2 AS ra FROM f),
w AS (SELECT season, week, position, count(*) AS n, sum(abs(ours - actual)) AS e, sum(abs(theirs - actual)) AS f, CASE WHEN count(*) >= 10 AND stddev_pop(ro) > 0 AND stddev_pop(ra) > 0 THEN corr(ro, ra) END AS co, CASE WHEN count(*) >= 10 AND stddev_pop(rt) > 0 AND stddev_pop(ra) > 0 THEN corr(rt, ra) END AS ct FROM r GROUP BY season, week, position),
s AS (SELECT DISTINCT season, week, unnest(['QB', 'RB', 'WR', 'TE']) AS position FROM g),
t AS (SELECT season, week, position, coalesce(sum(n) OVER c, 0) AS n, coalesce(sum(e) OVER c, 0) AS e, coalesce(sum(f) OVER c, 0) AS f, avg(co) OVER c - avg(ct) OVER c AS rank_gap, row_number() OVER c AS weeks FROM s LEFT JOIN w USING (season, week, position) WINDOW c AS (PARTITION BY season, position ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
k AS (SELECT * FROM t WHERE n > 0), o AS (SELECT season, week, sum(n) AS n, sum(e) AS e, sum(f) AS f, max(weeks) AS weeks, bool_and(coalesce(rank_gap >= -0.01, false)) AS ordered FROM k GROUP BY season, week),
u AS (SELECT season, week, position, n, e, f, rank_gap, weeks FROM k UNION ALL SELECT season, week, 'OVERALL', n, e, f, NULL, weeks FROM o)
SELECT u.season, u.week, u.position, CAST(u.n AS BIGINT) AS n, CAST(u.weeks AS BIGINT) AS weeks, round(u.e / u.n + 1e-9, 6) AS mae, round((u.e - u.f) / u.n + 1e-9, 6) AS gap, round(u.rank_gap + 1e-9, 6) AS rank_gap, o.e <= o.f AND o.ordered AS gate FROM u JOIN o ON u.season = o.season AND u.week = o.week""")
def season_to_date_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and rank correlations against the consensus from the third week up to each week, with one gate for the whole table."""
    position = F.get(F.array(*map(F.lit, ("QB", "RB", "WR", "TE", "K"))), (F.col("l_suppkey") % 5).cast("int"))
    matched = table(spark, sf_dir, "lineitem").select(position.alias("position"), F.year("l_shipdate").cast("long").alias("season"), F.month("l_shipdate").cast("long").alias("week"), (F.col("l_quantity") * 0.6 + F.col("l_partkey") % 23).alias("ours"), (F.col("l_quantity") * 0.4 + F.col("l_partkey") % 11).alias("theirs"), F.col("l_quantity").alias("actual"))
    out = cumulative_accuracy(matched, ("QB", "RB", "WR", "TE"))
    return out.select("season", "week", "position", "n", "weeks", fixed("mae").alias("mae"), fixed("gap").alias("gap"), fixed("rank_gap").alias("rank_gap"), "gate")


@query("""WITH p AS (SELECT p_partkey AS player, p_brand AS position, p_retailprice + p_size * 3 AS points, p_size FROM part), o AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY points DESC, player) AS ours, row_number() OVER (PARTITION BY position ORDER BY player % 37 DESC, player) AS theirs FROM p)
SELECT position, player, CAST(ours AS BIGINT) AS ours, CAST(theirs AS BIGINT) AS theirs FROM o WHERE ours <= 3 AND theirs > 6""")
def top_cross_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Our three best of a position that are not among the six best of another source."""
    g = Window.partitionBy("position")
    b = boards(spark, sf_dir)
    place = lambda c, n: b.select("position", "player", F.row_number().over(g.orderBy((F.col(c) if isinstance(c, str) else c).desc(), "player")).cast("long").alias(n))
    missing = place("points", "ours").where("ours <= 3").join(place(F.col("player") % 37, "theirs").where("theirs > 6"), ["position", "player"])
    return missing.select("position", "player", "ours", "theirs")


@query("""WITH s AS (SELECT user_id, CASE WHEN event_id % 3 = 0 THEN 'rss_' || event_type WHEN event_id % 3 = 1 THEN 'social_' || event_type ELSE 'official' END AS source FROM events)
SELECT user_id, CAST(count_if(source LIKE '%rss%') AS BIGINT) AS rss, CAST(count_if(source LIKE '%social%') AS BIGINT) AS social, CAST(count_if(source NOT LIKE '%rss%' AND source NOT LIKE '%social%') AS BIGINT) AS other FROM s GROUP BY user_id""")
def source_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by a part of the source's name, a column each."""
    k = F.col("event_id") % 3
    s = table(spark, sf_dir, "events").select("user_id", F.when(k == 0, F.concat(F.lit("rss_"), "event_type")).when(k == 1, F.concat(F.lit("social_"), "event_type")).otherwise("official").alias("source"))
    rss, social = F.col("source").contains("rss"), F.col("source").contains("social")
    return s.groupBy("user_id").agg(F.count_if(rss).alias("rss"), F.count_if(social).alias("social"), F.count_if(~rss & ~social).alias("other"))


@query("""WITH {plays}, s AS (SELECT DISTINCT team, season, week FROM plays), o AS (SELECT team, season, week, avg(epa) AS epa, count(*) AS n FROM plays GROUP BY ALL), d AS (SELECT opp AS team, season, week, avg(epa) AS allowed, max(value) AS most FROM plays GROUP BY ALL), y AS (SELECT team, season, sum(yards) AS season_yards FROM plays GROUP BY ALL)
SELECT team, season, week, round(epa + 1e-9, 6) AS epa, CAST(n AS BIGINT) AS n, round(allowed + 1e-9, 6) AS allowed, round(season_yards + 1e-9, 4) AS season_yards FROM s LEFT JOIN o USING (team, season, week) LEFT JOIN d USING (team, season, week) LEFT JOIN y USING (team, season)""")
def feature_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spine of teams and weeks with the features of three tables of unlike keys; a column that stands already is passed over."""
    p, week = plays(spark, sf_dir), ["team", "season", "week"]
    offence = p.groupBy(*week).agg(F.avg("epa").alias("epa"), F.count("*").alias("n"))
    defence = p.groupBy(F.col("opp").alias("team"), "season", "week").agg(F.avg("epa").alias("allowed"), F.count("*").alias("n"))
    season = p.groupBy("team", "season").agg(F.sum("yards").alias("season_yards"))
    out = star(p.select(*week).distinct(), [(offence, week), (defence, week), (season, ["team", "season"])])
    return out.select(*week, fixed("epa").alias("epa"), "n", fixed("allowed").alias("allowed"), fixed("season_yards", 4).alias("season_yards"))

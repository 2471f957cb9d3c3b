"""Player-week metrics: shares, matchups, allowances, profiles and the weekly projection."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelag.functions import windows as W
from tidelag.functions.scalars import clip, fixed, linear_score, ratio, saturating_weight
from tidelag.plans.inputs import plays, query
from tidelag.sources.tables import table

T3 = ("team", "season", "week")

# Baseline weights of (last three, last six, season to date), matchup slopes, shrink ladder and floors.
BASELINE = {"QB": (0.10, 0.05, 0.85), "RB": (0.30, 0.15, 0.55), "WR": (0.0, 0.0, 1.0), "TE": (0.15, 0.0, 0.85)}
MATCHUP_SLOPE = {"QB": 0.15, "RB": 1.50, "WR": 0.15, "TE": 0.50}
SHRINK = ((12.0, 0.92), (18.0, 0.87), (23.0, 0.80))
FLOOR = {"QB": (5.0, 1.0), "RB": (3.0, 0.5), "WR": (3.0, 0.5), "TE": (2.5, 0.3)}
SPREAD = {"QB": 0.45, "RB": 0.40, "WR": 0.38, "TE": 0.35}


def by_position(values: dict, column: str = "position") -> F.Column:
    """The value of a position, null for others."""
    return reduce(lambda c, kv: F.when(F.col(column) == kv[0], F.lit(kv[1])).otherwise(c), reversed(list(values.items())), F.lit(None).cast("double"))


@query("""WITH {plays}, p AS (SELECT team, season, week, player, sum(yards) AS y, CAST(count(*) AS BIGINT) AS touches FROM plays GROUP BY ALL)
SELECT team, season, week, player, round(y / sum(y) OVER g + 1e-9, 6) AS yard_share, round(touches / sum(touches) OVER g + 1e-9, 6) AS touch_share FROM p WINDOW g AS (PARTITION BY team, season, week)""")
def usage_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the team's week."""
    p = plays(spark, sf_dir).groupBy(*T3, "player").agg(F.sum("yards").alias("y"), F.count("*").alias("touches"))
    return p.select(*T3, "player", fixed(W.share("y", *T3)).alias("yard_share"), fixed(W.share("touches", *T3)).alias("touch_share"))


@query("""WITH {plays}, a AS (SELECT opp, season, week, round(avg(yards) + 1e-9, 6) AS allowed FROM plays GROUP BY ALL)
SELECT opp, season, week, allowed, CAST(floor(rank() OVER (PARTITION BY season, week ORDER BY allowed DESC) + (count(*) OVER (PARTITION BY season, week, allowed) - 1) / 2) AS BIGINT) AS rank_average,
  CAST(rank() OVER (PARTITION BY season, week ORDER BY allowed DESC) AS BIGINT) AS rank_min, CAST(row_number() OVER (PARTITION BY season, week ORDER BY allowed DESC, opp) AS BIGINT) AS rank_first FROM a""")
def opponent_rank_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three kinds of rank; the average one is cut to a whole number."""
    a = plays(spark, sf_dir).groupBy("opp", "season", "week").agg(fixed(F.avg("yards")).alias("allowed"))
    w, ties = Window.partitionBy("season", "week").orderBy(F.desc("allowed")), Window.partitionBy("season", "week", "allowed")
    first = F.row_number().over(Window.partitionBy("season", "week").orderBy(F.desc("allowed"), "opp"))
    return a.select("opp", "season", "week", "allowed", W.rank_average(w, ties).cast("long").alias("rank_average"), F.rank().over(w).cast("long").alias("rank_min"), first.cast("long").alias("rank_first"))


@query("""WITH {plays}, a AS (SELECT opp, kind, season, week, avg(yards) AS y FROM plays GROUP BY ALL),
r AS (SELECT *, CASE WHEN count(y) OVER w >= 3 THEN avg(y) OVER w END AS t8 FROM a WINDOW w AS (PARTITION BY opp, kind ORDER BY season, week ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING))
SELECT opp, kind, season, week, round(t8 + 1e-9, 6) AS trailing8, round(t8 / avg(t8) OVER (PARTITION BY season, week, kind) + 1e-9, 6) AS to_league FROM r""")
def trailing8_ratio_to_league(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a defence allowed over its last eight games, across seasons, against the league's week."""
    a = plays(spark, sf_dir).groupBy("opp", "kind", "season", "week").agg(F.avg("yards").alias("y"))
    r = a.withColumn("t8", W.lagged_mean("y", W.by(("opp", "kind"), ("season", "week")), 8, 3))
    return r.select("opp", "kind", "season", "week", fixed("t8").alias("trailing8"), fixed(W.to_group_mean("t8", "season", "week", "kind")[0]).alias("to_league"))


@query("""WITH {plays}, a AS (SELECT opp, season, week, avg(yards) AS yards, avg(value) AS value, avg(epa) AS epa FROM plays GROUP BY ALL), l AS (SELECT opp, season, week, stat, v FROM a UNPIVOT (v FOR stat IN (yards, value, epa)))
SELECT opp, season, week, stat, round(v + 1e-9, 4) AS v, round(v - avg(v) OVER (PARTITION BY season, week, stat) + 1e-9, 4) AS over_league, round(avg(v) OVER (PARTITION BY opp, season, stat ORDER BY week ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) + 1e-9, 4) AS roll3 FROM l""")
def yardage_allowance_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide to long, then windows per statistic."""
    a = plays(spark, sf_dir).groupBy("opp", "season", "week").agg(*[F.avg(c).alias(c) for c in ("yards", "value", "epa")])
    l = a.unpivot(["opp", "season", "week"], ["yards", "value", "epa"], "stat", "v")
    w = W.by(("opp", "season", "stat"), ("week",))
    return l.select("opp", "season", "week", "stat", fixed("v", 4).alias("v"), fixed(W.to_group_mean("v", "season", "week", "stat")[1], 4).alias("over_league"), fixed(W.lagged_mean("v", w, 3), 4).alias("roll3"))


@query("""WITH {plays}, p AS (SELECT team, season, player, CAST(count(*) AS BIGINT) AS n, sum(yards) AS y FROM plays GROUP BY ALL)
SELECT team, season, player AS primary_player, n FROM (SELECT *, row_number() OVER (PARTITION BY team, season ORDER BY n DESC, y DESC, player) AS i FROM p) WHERE i = 1""")
def primary_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The player with most plays of a team's season, as one aggregate without a window."""
    p = plays(spark, sf_dir).groupBy("team", "season", "player").agg(F.count("*").alias("n"), F.sum("yards").alias("y"))
    best = F.max(F.struct("n", "y", (-F.col("player")).alias("p"))).alias("b")
    return p.groupBy("team", "season").agg(best).select("team", "season", (-F.col("b.p")).alias("primary_player"), "b.n")


@query("""WITH {plays}, z AS (SELECT team, season, week, player, CASE WHEN value < 30000 THEN 'near' WHEN value < 60000 THEN 'mid' ELSE 'far' END AS zone, yards FROM plays),
p AS (SELECT team, season, player, coalesce(sum(yards) FILTER (zone = 'near'), 0) AS near, coalesce(sum(yards) FILTER (zone = 'mid'), 0) AS mid, coalesce(sum(yards) FILTER (zone = 'far'), 0) AS far FROM z GROUP BY ALL)
SELECT team, season, player, round(near + 1e-9, 4) AS near, round(mid + 1e-9, 4) AS mid, round(far + 1e-9, 4) AS far, round(CASE WHEN near + mid + far > 0 THEN near / (near + mid + far) ELSE 0 END + 1e-9, 6) AS near_rate FROM p""")
def zone_usage_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long to wide over named zones, missing ones 0."""
    zone = F.when(F.col("value") < 30000, "near").when(F.col("value") < 60000, "mid").otherwise("far")
    p = plays(spark, sf_dir).withColumn("zone", zone).groupBy("team", "season", "player").pivot("zone", ["near", "mid", "far"]).agg(F.sum("yards")).fillna(0.0)
    return p.select("team", "season", "player", *[fixed(c, 4).alias(c) for c in ("near", "mid", "far")], fixed(ratio(F.col("near"), F.col("near") + F.col("mid") + F.col("far"), 0.0)).alias("near_rate"))


@query("""WITH {plays}, p AS (SELECT team, season, week, player, count(*) AS n, sum(yards) AS y FROM plays WHERE kind = 'pass' GROUP BY ALL),
s AS (SELECT team, season, player, sum(n) AS targets, sum(y) AS yards, count(*) AS weeks, sum(tn) AS team_n, sum(ty) AS team_y FROM (SELECT *, sum(n) OVER g AS tn, sum(y) OVER g AS ty FROM p WINDOW g AS (PARTITION BY team, season, week)) GROUP BY ALL)
SELECT team, season, player, CAST(targets AS BIGINT) AS targets, CAST(weeks AS BIGINT) AS weeks, round(1.5 * targets / team_n + 0.7 * yards / team_y + 1e-9, 6) AS wopr, round(targets / team_n * (yards / team_y) + 1e-9, 6) AS dominator FROM s""")
def seasonal_composites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Season totals from weeks, over the team's totals of the weeks that the player was in."""
    p = plays(spark, sf_dir).where("kind = 'pass'").groupBy(*T3, "player").agg(F.count("*").alias("n"), F.sum("yards").alias("y"))
    g = Window.partitionBy(*T3)
    s = p.withColumns({"tn": F.sum("n").over(g), "ty": F.sum("y").over(g)}).groupBy("team", "season", "player")
    s = s.agg(F.sum("n").alias("targets"), F.sum("y").alias("yards"), F.count("*").alias("weeks"), F.sum("tn").alias("tn"), F.sum("ty").alias("ty"))
    a, b = F.col("targets") / F.col("tn"), F.col("yards") / F.col("ty")
    return s.select("team", "season", "player", "targets", "weeks", fixed(1.5 * a + 0.7 * b).alias("wopr"), fixed(a * b).alias("dominator"))


@query("""WITH {plays}, p AS (SELECT team, player, season, week, avg(epa) AS e, count(*) AS n FROM plays WHERE kind <> 'run' GROUP BY ALL)
SELECT team, player, season, week, round(avg(e) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) + 1e-9, 6) AS pair_roll3, CAST(coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS plays_before, CAST(row_number() OVER w - 1 AS BIGINT) AS games_before
FROM p WINDOW w AS (PARTITION BY team, player ORDER BY season, week)""")
def pair_chemistry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair's recent mean and its career before the game."""
    p = plays(spark, sf_dir).where("kind <> 'run'").groupBy("team", "player", "season", "week").agg(F.avg("epa").alias("e"), F.count("*").alias("n"))
    w = W.by(("team", "player"), ("season", "week"))
    before = F.coalesce(W.lagged_sum("n", w), F.lit(0)).cast("long")
    return p.select("team", "player", "season", "week", fixed(W.lagged_mean("e", w, 3)).alias("pair_roll3"), before.alias("plays_before"), (F.row_number().over(w) - 1).cast("long").alias("games_before"))


@query("""SELECT l_orderkey AS game, l_linenumber AS play_no, l_partkey AS player, round(coalesce(l_quantity, 0) * 0.1 + coalesce(l_tax, 0) * 6 + coalesce(l_discount, 0) * 4 + coalesce(l_extendedprice, 0) * 0.0001 + 1e-9, 2) AS points FROM lineitem""")
def linear_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A league's scoring rule as a weighted sum of columns."""
    weights = {"l_quantity": 0.1, "l_tax": 6.0, "l_discount": 4.0, "l_extendedprice": 0.0001}
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("game"), F.col("l_linenumber").alias("play_no"), F.col("l_partkey").alias("player"), linear_score(weights).alias("points"))


_PROFILE = "p AS (SELECT p_partkey AS player, p_brand AS position, CAST(p_size AS DOUBLE) AS size, p_retailprice AS speed FROM part)"


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("player"), F.col("p_brand").alias("position"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("speed"))


@query(f"WITH {_PROFILE}" + """ SELECT player, round((rank() OVER (PARTITION BY position ORDER BY size) + (count(*) OVER (PARTITION BY position, size) - 1) / 2) / count(*) OVER (PARTITION BY position) + 1e-9, 6) AS size_pct,
  round(least(greatest(0.8 + 0.35 * (rank() OVER (PARTITION BY position ORDER BY size) + (count(*) OVER (PARTITION BY position, size) - 1) / 2) / count(*) OVER (PARTITION BY position), 0.8), 1.15) + 1e-9, 6) AS usage FROM p""")
def percentile_in_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average percentile rank within a position, and the usage multiplier made of it."""
    g = Window.partitionBy("position")
    pct = W.rank_percent(g.orderBy("size"), Window.partitionBy("position", "size"), g)
    return _profiles(spark, sf_dir).select("player", fixed(pct).alias("size_pct"), fixed(clip(0.8 + 0.35 * pct, 0.8, 1.15)).alias("usage"))


@query(f"WITH {_PROFILE}" + """ SELECT player, round(CASE WHEN count(size) OVER g >= 3 AND stddev_samp(size) OVER g > 0 THEN greatest(least((size - avg(size) OVER g) / stddev_samp(size) OVER g, 3), -3) END + 1e-9, 6) AS size_z,
  round(size * 703 / (speed / 20) / (speed / 20) + 1e-9, 6) AS mass_index FROM p WINDOW g AS (PARTITION BY position)""")
def zscore_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clipped z-score in the position, beside a profile measure."""
    mass = F.col("size") * 703 / (F.col("speed") / 20) / (F.col("speed") / 20)
    return _profiles(spark, sf_dir).select("player", fixed(W.zscore("size", "position")).alias("size_z"), fixed(mass).alias("mass_index"))


@query(f"WITH {_PROFILE}" + """, z AS (SELECT player, position, (size - avg(size) OVER ()) / stddev_samp(size) OVER () AS a, (speed - avg(speed) OVER ()) / stddev_samp(speed) OVER () AS b, size FROM p),
d AS (SELECT q.player, r.player AS other, r.size, round(sqrt((q.a - r.a) ** 2 + (q.b - r.b) ** 2) + 1e-9, 6) AS dist FROM z q JOIN z r ON q.position = r.position AND q.player <> r.player WHERE q.player % 50 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY dist, other) AS i FROM d)
SELECT player, round(median(size) + 1e-9, 6) AS comp_median, round(quantile_cont(size, 0.25) + 1e-9, 6) AS comp_low, round(max(dist) + 1e-9, 6) AS farthest FROM t WHERE i <= 10 GROUP BY player""")
def knn_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest profiles of the same position for the stated queries (ids divisible by 50), and their outcomes.

    Equal profiles are one class with its eleven smallest ids, of which a query's ten nearest take no more, its
    own id left out. Classes are compared, so work grows with the different sizes and speeds of a position.
    """
    p, traits = _profiles(spark, sf_dir), ["position", "size", "speed"]
    s = p.agg(*[f(c).alias(f"{n}_{c}") for c in ("size", "speed") for f, n in ((F.avg, "m"), (F.stddev_samp, "s"))])
    first = lambda d, keys, order: d.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    scaled = lambda d: d.join(F.broadcast(s)).select("*", *[((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).alias(x) for c, x in (("size", "a"), ("speed", "b"))])
    c = scaled(first(p, traits, ["player"]).where("i <= 11").groupBy(*traits).agg(F.array_sort(F.collect_list("player")).alias("ids")))
    c = c.select("position", "a", "b", "ids", F.element_at("ids", 1).alias("least"), F.col("size").alias("other"))
    asked = p.where("player % 50 = 0")
    q = scaled(asked.select(*traits).distinct()).select(*traits, F.col("a").alias("qa"), F.col("b").alias("qb"))
    dist = fixed(F.sqrt(F.pow(F.col("a") - F.col("qa"), 2) + F.pow(F.col("b") - F.col("qb"), 2)))
    d = first(q.join(c, "position").withColumn("dist", dist), traits, ["dist", "least"]).where("i <= 11")
    d = first(d.select(*traits, "other", "dist", F.explode("ids").alias("comp")), traits, ["dist", "comp"]).where("i <= 11")
    same = [asked[x].eqNullSafe(d[x]) for x in traits]
    each = asked.join(d, same).where("player <> comp").select("player", "other", "dist", "comp")
    near = first(each, ["player"], ["dist", "comp"]).where("i <= 10")
    return near.groupBy("player").agg(fixed(F.percentile("other", 0.5)).alias("comp_median"), fixed(F.percentile("other", 0.25)).alias("comp_low"), fixed(F.max("dist")).alias("farthest"))


#: Vectors of a tile, on either side.
VECTOR_TILE = 10_000


def _nearly_best(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
    """(q, vec_id, near) of a tile: each query's five best rows by about their cosine, and what nearly ties; unknown ones all.

    Vectors of other lengths, with nulls or of length 0 have an unknown cosine, NaN, which Spark decides.
    """
    if x.empty or y.empty:
        return pd.DataFrame(columns=["q", "vec_id", "near"])
    width = max(len(v) for d in (x["qv"], y["v"]) for v in d if v is not None)

    def matrix(vectors: pd.Series) -> np.ndarray:
        out = np.full((len(vectors), width), np.nan)
        for i, v in enumerate(vectors):
            if v is not None:
                out[i, : len(v)] = np.asarray(v, float)
        with np.errstate(all="ignore"):
            return out / np.sqrt((out * out).sum(axis=1, keepdims=True))

    a, b, q, ids, found = matrix(x["qv"]), matrix(y["v"]).T, x["q"].to_numpy(), y["vec_id"].to_numpy(), []
    for at in range(0, len(q), 100):
        with np.errstate(all="ignore"):
            near = a[at : at + 100] @ b
        near[q[at : at + 100, None] == ids[None, :]] = -np.inf
        keep = np.isnan(near)
        known = np.where(keep, -np.inf, near)
        if len(ids) > 5:
            known_best = np.partition(known, len(ids) - 5, axis=1)[:, len(ids) - 5, None]
            keep |= known >= known_best - 4e-6
        else:
            keep[:] = True
        i, j = np.nonzero(keep & (near != -np.inf))
        found.append(pd.DataFrame({"q": q[at + i], "vec_id": ids[j], "near": near[i, j]}))
    return pd.concat(found)


@query("""WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0), d AS (SELECT q.vec_id, e.vec_id AS other, e.label, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) + 1e-9, 6) AS similarity FROM q JOIN embeddings e ON q.vec_id <> e.vec_id)
SELECT vec_id, other, label, similarity FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, other) AS i FROM d) WHERE i <= 5""")
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest vectors by cosine for the stated queries (ids divisible by 50) against all rows.

    Tiles of queries meet tiles of rows in products of matrices, which keep each query's five best and all that
    nearly tie with them; the similarity of those is then worked out and ranked in Spark.
    """
    e = table(spark, sf_dir, "embeddings").where("vec_id IS NOT NULL").withColumn("v", F.transform("embedding", lambda x: x.cast("double")))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    e = e.select("vec_id", "label", "v", norm(F.col("v")).alias("norm"))
    asked = e.where("vec_id % 50 = 0")
    tiles = lambda d: d.count() // VECTOR_TILE + 1
    n, m = tiles(e), tiles(asked)
    tile = lambda d, own, k, other, others: d.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.lit(k))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))))
    x = tile(asked.select("vec_id", "v"), "qt", m, "et", n).select(F.col("vec_id").alias("q"), F.col("v").alias("qv"), F.col("qt").alias("q_qt"), F.col("et").alias("q_et"))
    y = tile(e.select("vec_id", "v"), "et", n, "qt", m)
    kind = e.schema["vec_id"].dataType.simpleString()
    pairs = x.groupBy("q_qt", "q_et").cogroup(y.groupBy("qt", "et")).applyInPandas(_nearly_best, f"q {kind}, vec_id {kind}, near double")
    known, of = F.when(~F.isnan("near"), F.col("near")), Window.partitionBy("q")
    pairs = pairs.withColumn("known", known).withColumn("i", F.row_number().over(of.orderBy(F.desc("known"), "vec_id")))
    pairs = pairs.withColumn("least", F.min(F.when(F.col("i") <= 5, F.col("known"))).over(of))
    pairs = pairs.where(F.col("known").isNull() | (F.col("known") >= F.col("least") - 4e-6)).select("q", "vec_id")
    q = asked.select(F.col("vec_id").alias("q"), F.col("v").alias("qv"), F.col("norm").alias("qn"))
    dot = F.aggregate(F.zip_with("v", "qv", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    d = pairs.hint("merge").join(q, "q").hint("merge").join(e, "vec_id").select("q", "vec_id", "label", fixed(dot / (F.col("norm") * F.col("qn"))).alias("similarity"))
    best = d.withColumn("i", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("similarity"), "vec_id"))).where("i <= 5")
    return best.select(F.col("q").alias("vec_id"), F.col("vec_id").alias("other"), "label", "similarity")


_SQL_CASE = lambda d: "CASE position " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in d.items()) + " END"


@query(f"""WITH {{plays}}, k AS (SELECT *, CASE player % 4 WHEN 0 THEN 'QB' WHEN 1 THEN 'RB' WHEN 2 THEN 'WR' ELSE 'TE' END AS position FROM plays),
a AS (SELECT player, position, season, week, min(team) AS team, min(opp) AS opp, sum(yards) * 0.1 + sum(success) * 2.0 AS points, count(*) AS touches FROM k GROUP BY ALL),
u AS (SELECT *, sum(points) OVER (PARTITION BY opp, season, week, position) AS opp_points FROM a),
w AS (SELECT *, avg(points) OVER r3 AS roll3, avg(points) OVER r6 AS roll6, avg(points) OVER rs AS std, avg(touches) OVER r3 AS usage FROM a
  WINDOW r3 AS (PARTITION BY player, season ORDER BY week ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), r6 AS (PARTITION BY player, season ORDER BY week ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), rs AS (PARTITION BY player, season ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
d AS (SELECT opp, position, season, week, avg(points) AS allowed FROM a GROUP BY ALL),
t AS (SELECT *, avg(allowed) OVER (PARTITION BY opp, position ORDER BY season, week ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS t8 FROM d),
m AS (SELECT *, t8 / avg(t8) OVER (PARTITION BY season, week, position) AS ratio FROM t),
b AS (SELECT w.*, coalesce(m.ratio, 1) AS ratio, {_SQL_CASE({k: v[0] for k, v in BASELINE.items()}).replace('position', 'w.position')} AS w3, {_SQL_CASE({k: v[1] for k, v in BASELINE.items()}).replace('position', 'w.position')} AS w6, {_SQL_CASE({k: v[2] for k, v in BASELINE.items()}).replace('position', 'w.position')} AS ws FROM w LEFT JOIN m ON w.opp = m.opp AND w.position = m.position AND w.season = m.season AND w.week = m.week WHERE std IS NOT NULL),
x AS (SELECT *, (coalesce(roll3, 0) * w3 + coalesce(roll6, 0) * w6 + coalesce(std, 0) * ws) / (w3 + w6 + ws) AS base,
  least(greatest(0.8 + 0.35 * (rank() OVER (PARTITION BY season, week, position ORDER BY usage) + (count(*) OVER (PARTITION BY season, week, position, usage) - 1) / 2) / count(*) OVER (PARTITION BY season, week, position), 0.8), 1.15) AS use_factor,
  least(greatest(1 + {_SQL_CASE(MATCHUP_SLOPE)} * (ratio - 1), 0.85), 1.15) AS match_factor FROM b),
y AS (SELECT *, base * use_factor * match_factor AS raw FROM x),
z AS (SELECT *, raw * CASE WHEN raw >= 23 THEN 0.80 WHEN raw >= 18 THEN 0.87 WHEN raw >= 12 THEN 0.92 ELSE 1 END AS shrunk FROM y),
f AS (SELECT *, shrunk + CASE WHEN shrunk < {_SQL_CASE({k: v[0] for k, v in FLOOR.items()})} THEN {_SQL_CASE({k: v[1] for k, v in FLOOR.items()})} ELSE 0 END AS lifted FROM z),
c AS (SELECT *, 20 / sum(lifted) OVER (PARTITION BY team, season, week) AS r FROM f),
g AS (SELECT *, round(lifted * CASE WHEN abs(r - 1) > 0.1 THEN 1 + 0.6 * (r - 1) ELSE 1 END + 1e-9, 4) AS projected FROM c)
SELECT player, position, season, week, team, projected, round(projected * (1 - {_SQL_CASE(SPREAD)}) + 1e-9, 4) AS floor_points, round(projected * (1 + {_SQL_CASE(SPREAD)}) + 1e-9, 4) AS ceiling_points, CAST(row_number() OVER (PARTITION BY season, week, position ORDER BY projected DESC, player) AS BIGINT) AS position_rank FROM g""")
def weekly_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baseline, usage and matchup factors, shrink ladder, floors, team budget, limits and ranks of each player's week.

    All is lagged: a week's projection uses earlier weeks alone. One aggregation of plays feeds it.
    """
    names = F.element_at(F.array(*[F.lit(p) for p in BASELINE]), (F.col("player") % 4 + 1).cast("int"))
    a = plays(spark, sf_dir).withColumn("position", names).groupBy("player", "position", "season", "week").agg(
        F.min("team").alias("team"), F.min("opp").alias("opp"), (F.sum("yards") * 0.1 + F.sum("success") * 2.0).alias("points"), F.count("*").alias("touches")
    )
    w = W.by(("player", "season"), ("week",))
    lagged = a.select("*", W.lagged_mean("points", w, 3).alias("roll3"), W.lagged_mean("points", w, 6).alias("roll6"), W.lagged_mean("points", w).alias("std"), W.lagged_mean("touches", w, 3).alias("usage"))
    d = a.groupBy("opp", "position", "season", "week").agg(F.avg("points").alias("allowed"))
    d = d.withColumn("t8", W.lagged_mean("allowed", W.by(("opp", "position"), ("season", "week")), 8))
    m = d.select("opp", "position", "season", "week", W.to_group_mean("t8", "season", "week", "position")[0].alias("ratio"))
    b = lagged.where("std IS NOT NULL").join(m, ["opp", "position", "season", "week"], "left")
    parts = [by_position({k: v[i] for k, v in BASELINE.items()}) for i in range(3)]
    base = sum((F.coalesce(F.col(c), F.lit(0.0)) * p for c, p in zip(("roll3", "roll6", "std"), parts, strict=True)), F.lit(0.0)) / (parts[0] + parts[1] + parts[2])
    g = Window.partitionBy("season", "week", "position")
    use = clip(0.8 + 0.35 * W.rank_percent(g.orderBy("usage"), Window.partitionBy("season", "week", "position", "usage"), g), 0.8, 1.15)
    match = clip(1 + by_position(MATCHUP_SLOPE) * (F.coalesce("ratio", F.lit(1.0)) - 1), 0.85, 1.15)
    y = b.withColumn("raw", base * use * match)
    ladder = reduce(lambda c, s: F.when(F.col("raw") >= s[0], F.lit(s[1])).otherwise(c), SHRINK, F.lit(1.0))
    z = y.withColumn("shrunk", F.col("raw") * ladder)
    lift = F.when(F.col("shrunk") < by_position({k: v[0] for k, v in FLOOR.items()}), by_position({k: v[1] for k, v in FLOOR.items()})).otherwise(0.0)
    f = z.withColumn("lifted", F.col("shrunk") + lift)
    r = 20 / F.sum("lifted").over(Window.partitionBy(*T3))
    out = f.withColumn("r", r).withColumn("projected", fixed(F.col("lifted") * F.when(F.abs(F.col("r") - 1) > 0.1, 1 + 0.6 * (F.col("r") - 1)).otherwise(1.0), 4))
    spread = by_position(SPREAD)
    rank = F.row_number().over(g.orderBy(F.desc("projected"), "player")).cast("long")
    return out.select("player", "position", "season", "week", "team", "projected", fixed(F.col("projected") * (1 - spread), 4).alias("floor_points"), fixed(F.col("projected") * (1 + spread), 4).alias("ceiling_points"), rank.alias("position_rank"))


@query("""WITH {plays}, s AS (SELECT player, season, sum(yards) AS y, count(DISTINCT week) AS games FROM plays GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY season DESC) AS i FROM s),
w AS (SELECT player, sum(y / games * CASE i WHEN 1 THEN 2.0 ELSE 1.0 END * least(games / 4, 1)) / sum(CASE i WHEN 1 THEN 2.0 ELSE 1.0 END * least(games / 4, 1)) AS rate, sum(games) AS games FROM n WHERE i <= 2 GROUP BY player)
SELECT player, round(rate * 17 + 1e-9, 4) AS preseason, round(least((1 - exp(-0.7 * games)) / (1 - exp(-3.5)), 1) + 1e-9, 6) AS veteran_weight FROM w""")
def season_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last two seasons' rates, the later one twice as heavy and few games lighter, for a season of 17."""
    s = plays(spark, sf_dir).groupBy("player", "season").agg(F.sum("yards").alias("y"), F.countDistinct("week").alias("games"))
    n = s.withColumn("i", F.row_number().over(Window.partitionBy("player").orderBy(F.desc("season")))).where("i <= 2")
    weight = F.when(F.col("i") == 1, 2.0).otherwise(1.0) * F.least(F.col("games") / 4, F.lit(1.0))
    w = n.groupBy("player").agg((F.sum(F.col("y") / F.col("games") * weight) / F.sum(weight)).alias("rate"), F.sum("games").alias("games"))
    return w.select("player", fixed(F.col("rate") * 17, 4).alias("preseason"), fixed(saturating_weight(F.col("games"), 0.7, 5)).alias("veteran_weight"))

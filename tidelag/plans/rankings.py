"""Ranks, tiers, values over replacement, blends and draft-room queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelag.functions import windows as W
from tidelag.functions.scalars import clip, fixed
from tidelag.plans.inputs import query
from tidelag.sources.tables import table

#: Replacement ranks of six positions, which brands take in turn.
REPLACEMENT = (13, 25, 30, 13, 13, 13)
#: Weight of the consensus, of it for a small sample, least drop of the curve.
ANCHOR, LOW_SAMPLE, DESCENT = 0.6, 0.85, 0.5
#: Fixed value: most points that the ranking signals move.
NUDGE_CAP = 1.5

_P = "p AS (SELECT p_partkey AS player, p_brand AS position, p_retailprice + p_size * 3 AS points, p_size FROM part)"


def boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("player"), F.col("p_brand").alias("position"), (F.col("p_retailprice") + F.col("p_size") * 3).alias("points"), "p_size")


def _ranked(df: DataFrame, name: str = "rk", group: str = "position") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(F.desc("points"), "player")))


@query(f"WITH {_P}" + """, r AS (SELECT *, row_number() OVER w AS rk, lag(points) OVER w - points AS gap FROM p WINDOW w AS (PARTITION BY position ORDER BY points DESC, player)), s AS (SELECT *, greatest(0.35 * stddev_pop(gap) OVER (PARTITION BY position), 0.5) AS cut FROM r),
b AS (SELECT *, CASE WHEN gap > cut THEN row_number() OVER (PARTITION BY position, gap > cut ORDER BY gap DESC, rk DESC) END AS place FROM s) SELECT player, position, CAST(rk AS BIGINT) AS rk, CAST(1 + sum(CASE WHEN place <= 9 THEN 1 ELSE 0 END) OVER (PARTITION BY position ORDER BY rk ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tier FROM b""")
def tiers_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new tier at each drop that is large for the position; the nine largest drops at most."""
    g = Window.partitionBy("position")
    r = _ranked(boards(spark, sf_dir)).withColumn("gap", F.lag("points").over(g.orderBy(F.desc("points"), "player")) - F.col("points"))
    s = r.withColumn("large", F.col("gap") > F.greatest(0.35 * F.stddev_pop("gap").over(g), F.lit(0.5)))
    b = s.withColumn("place", F.when(F.col("large"), F.row_number().over(Window.partitionBy("position", "large").orderBy(F.desc("gap"), F.desc("rk")))))
    out = W.islands(b, F.col("place") <= 9, W.by(("position",), ("rk",)), "breaks")
    return out.select("player", "position", F.col("rk").cast("long").alias("rk"), (F.col("breaks") + 1).alias("tier"))


@query(f"WITH {_P}" + """, r AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY points DESC, player) AS rk, count(*) OVER (PARTITION BY position) AS n FROM p), v AS (SELECT r.*, r.points - max(CASE WHEN rk = least([13, 25, 30, 13, 13, 13][CAST(substr(position, 7) AS INT) % 6 + 1], n) THEN points END) OVER (PARTITION BY position) AS vorp FROM r)
SELECT player, position, round(vorp + 1e-9, 4) AS vorp, CAST(row_number() OVER (ORDER BY round(vorp + 1e-9, 4) DESC, player) AS BIGINT) AS overall FROM v QUALIFY overall <= 200""")
def vorp_nth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value over the replacement of the position (the last of a short one), and the 200 best overall."""
    g = Window.partitionBy("position")
    r = _ranked(boards(spark, sf_dir)).withColumn("n", F.count("*").over(g))
    replacement = F.get(F.array(*map(F.lit, REPLACEMENT)), F.substring("position", 7, 9).cast("int") % len(REPLACEMENT))
    v = r.withColumn("vorp", fixed(F.col("points") - F.max(F.when(F.col("rk") == F.least(replacement, F.col("n")), F.col("points"))).over(g), 4))
    best = v.orderBy(F.desc("vorp"), "player").limit(200)
    return best.select("player", "position", "vorp", F.row_number().over(Window.orderBy(F.desc("vorp"), "player")).cast("long").alias("overall"))


@query(f"WITH {_P}" + """ SELECT position, player, CAST(rk AS BIGINT) AS rk, points FROM (SELECT *, row_number() OVER (PARTITION BY position ORDER BY points DESC, player) AS rk FROM p) WHERE rk <= 3""")
def top_k_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three best of each position; Spark keeps three per task before the shuffle."""
    return _ranked(boards(spark, sf_dir)).where("rk <= 3").select("position", "player", F.col("rk").cast("long").alias("rk"), "points")


@query(f"WITH {_P}" + f""", r AS (SELECT player, position, points / 10 AS x, p_size, row_number() OVER (PARTITION BY position ORDER BY points DESC, player) AS i, (row_number() OVER (PARTITION BY position ORDER BY p_size DESC, player) + row_number() OVER (PARTITION BY position ORDER BY player)) / 2.0 AS consensus FROM p),
e AS (SELECT *, min(x + {DESCENT} * i) OVER (PARTITION BY position ORDER BY i ROWS UNBOUNDED PRECEDING) - {DESCENT} * i AS y FROM r), m AS (SELECT e.*, a.y + (e.consensus - a.i) * (b.y - a.y) AS implied, CASE WHEN e.p_size < 5 THEN {LOW_SAMPLE} ELSE {ANCHOR} END AS w FROM e JOIN e a ON a.position = e.position AND a.i = floor(e.consensus) JOIN e b ON b.position = e.position AND b.i = ceil(e.consensus))
SELECT player, position, round(y + 1e-9, 6) AS curve, round(implied + 1e-9, 6) AS implied, round(greatest((1 - w) * x + w * implied, 0) + 1e-9, 6) AS blended FROM m""")
def monotone_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The falling envelope of a position's points, its value at each consensus rank, and the blend of both."""
    g = Window.partitionBy("position")
    place = lambda *by: F.row_number().over(g.orderBy(*by))
    r = boards(spark, sf_dir).select("player", "position", "p_size", (F.col("points") / 10).alias("x"), place(F.desc("points"), "player").alias("i"), ((place(F.desc("p_size"), "player") + place("player")) / 2.0).alias("consensus"))
    e = r.withColumn("y", W.decreasing_envelope("x", "i", W.by(("position",), ("i",)), DESCENT))
    m = e.withColumns({"below": F.floor("consensus").cast("int"), "above": F.ceil("consensus").cast("int")})
    for end in ("below", "above"):
        m = m.join(e.select("position", F.col("i").alias(end), F.col("y").alias(f"y_{end}")), ["position", end])
    implied = F.col("y_below") + (F.col("consensus") - F.col("below")) * (F.col("y_above") - F.col("y_below"))
    w = F.when(F.col("p_size") < 5, LOW_SAMPLE).otherwise(ANCHOR)
    return m.select("player", "position", fixed("y").alias("curve"), fixed(implied).alias("implied"), fixed(F.greatest((1 - w) * F.col("x") + w * implied, F.lit(0.0))).alias("blended"))


@query(f"WITH {_P}" + """, r AS (SELECT *, (p_size % 50) / 50.0 AS gone, row_number() OVER (PARTITION BY position ORDER BY points DESC, player) AS i FROM p), s AS (SELECT *, CASE WHEN coalesce(max(CASE WHEN gone <= 0 THEN 1 ELSE 0 END) OVER w, 0) = 1 THEN 0.0 ELSE exp(coalesce(sum(CASE WHEN gone > 0 THEN ln(gone) END) OVER w, 0)) END AS reach FROM r WINDOW w AS (PARTITION BY position ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT position, round(sum(reach * (1 - gone) * points) + 1e-9, 4) AS expected_best FROM s GROUP BY position""")
def survival_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected value of the best that is left: each counts by the chance that all better ones are gone."""
    r = _ranked(boards(spark, sf_dir), "i").withColumn("gone", (F.col("p_size") % 50) / 50.0)
    s = r.withColumn("reach", W.lagged_product("gone", W.by(("position",), ("i",))))
    return s.groupBy("position").agg(fixed(F.sum(F.col("reach") * (1 - F.col("gone")) * F.col("points")), 4).alias("expected_best"))


@query(f"WITH {_P}" + """, s AS (SELECT player, position, row_number() OVER (PARTITION BY position ORDER BY points DESC, player) AS a, row_number() OVER (PARTITION BY position ORDER BY p_size DESC, player) AS b, row_number() OVER (PARTITION BY position ORDER BY player) AS c FROM p), m AS (SELECT player, position, list_sort([a, b, c])[2] AS median_rank, round((a + b + c) / 3.0 + 1e-9, 6) AS mean_rank FROM s)
SELECT player, position, CAST(median_rank AS BIGINT) AS median_rank, mean_rank, CAST(rank() OVER (PARTITION BY position ORDER BY mean_rank) AS BIGINT) AS consensus FROM m""")
def average_rank_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and mean of three sources' ranks, and the rank of the mean."""
    g = Window.partitionBy("position")
    orders = ([F.desc("points"), F.asc("player")], [F.desc("p_size"), F.asc("player")], [F.asc("player")])
    s = boards(spark, sf_dir).select("player", "position", F.array(*[F.row_number().over(g.orderBy(*o)) for o in orders]).alias("r"))
    mean = fixed(F.aggregate("r", F.lit(0), lambda a, x: a + x) / 3.0)
    m = s.select("player", "position", F.sort_array("r")[1].cast("long").alias("median_rank"), mean.alias("mean_rank"))
    return m.withColumn("consensus", F.rank().over(g.orderBy("mean_rank")).cast("long"))


@query(f"WITH {_P}" + """, n AS (SELECT player, position, points, p_size, lag(points) OVER w AS up, lag(p_size) OVER w AS us, lead(points) OVER w AS down, lead(p_size) OVER w AS ds FROM p WINDOW w AS (PARTITION BY position ORDER BY points DESC, player))
SELECT player, position, round(points + CASE WHEN up - points < 3 AND p_size > us THEN 0.5 ELSE 0 END - CASE WHEN points - down < 3 AND ds > p_size THEN 0.5 ELSE 0 END + 1e-9, 4) AS nudged FROM n""")
def neighbour_tiebreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near ties are nudged by a second measure, from either neighbour."""
    w = Window.partitionBy("position").orderBy(F.desc("points"), "player")
    up, us, down, ds = F.lag("points").over(w), F.lag("p_size").over(w), F.lead("points").over(w), F.lead("p_size").over(w)
    lift = F.when((up - F.col("points") < 3) & (F.col("p_size") > us), 0.5).otherwise(0.0)
    drop = F.when((F.col("points") - down < 3) & (ds > F.col("p_size")), 0.5).otherwise(0.0)
    return boards(spark, sf_dir).select("player", "position", fixed(F.col("points") + lift - drop, 4).alias("nudged"))


@query(f"WITH {_P}" + """, v AS (SELECT *, points - avg(points) OVER (PARTITION BY position) AS vorp FROM p) SELECT player, position, round(1 + greatest(vorp, 0) / sum(greatest(vorp, 0)) OVER () * 1000 + 1e-9, 4) AS dollars FROM v""")
def auction_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dollars by share of positive value; the total is one row, so no window runs over all rows."""
    v = boards(spark, sf_dir).withColumn("v", F.greatest(W.to_group_mean("points", "position")[1], F.lit(0.0)))
    return v.join(F.broadcast(v.agg(F.sum("v").alias("all"))), how="cross").select("player", "position", fixed(1 + F.col("v") / F.col("all") * 1000, 4).alias("dollars"))


@query("""WITH e AS (SELECT event_id, user_id % 12 AS room, event_type, row_number() OVER (PARTITION BY user_id % 12 ORDER BY ts, event_id) AS pick FROM events)
SELECT room, CAST(pick AS BIGINT) AS pick, event_type, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY room ORDER BY pick ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) >= 3 AS run, CAST(CASE WHEN (pick - 1) // 12 % 2 = 0 THEN (pick - 1) % 12 + 1 ELSE 12 - (pick - 1) % 12 END AS BIGINT) AS slot FROM e""")
def positional_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of one kind in the last four picks, and whose pick it is in a snake of twelve."""
    e = table(spark, sf_dir, "events").withColumn("room", F.col("user_id") % 12)
    e = e.withColumn("pick", F.row_number().over(W.by(("room",), ("ts", "event_id"))).cast("long"))
    run = F.sum(F.when(F.col("event_type") == "click", 1).otherwise(0)).over(W.by(("room",), ("pick",)).rowsBetween(-3, 0)) >= 3
    i = F.col("pick") - 1
    slot = F.when(F.floor(i / 12) % 2 == 0, i % 12 + 1).otherwise(12 - i % 12)
    return e.select("room", "pick", "event_type", run.alias("run"), slot.alias("slot"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS i, n / sum(n) OVER (PARTITION BY user_id) AS share FROM c), f AS (SELECT user_id, min(event_id) FILTER (event_type = 'purchase') AS first_purchase FROM events GROUP BY ALL)
SELECT r.user_id, event_type AS favourite, round(share + 1e-9, 6) AS share, first_purchase FROM r JOIN f ON r.user_id = f.user_id WHERE i = 1""")
def manager_mode_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each manager's commonest choice, its share and the first of a kind, in one aggregation of counts."""
    c = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    top = F.min(F.struct((-F.col("n")).alias("m"), F.col("event_type").alias("t"))).alias("b")
    g = c.groupBy("user_id").agg(top, F.sum("n").alias("all"), F.min(F.when(F.col("event_type") == "purchase", F.col("first"))).alias("first_purchase"))
    return g.select("user_id", F.col("b.t").alias("favourite"), fixed(-F.col("b.m") / F.col("all")).alias("share"), "first_purchase")


@query("""SELECT user_id % 12 AS room, event_type, min(event_id) AS first_pick, CAST(count(*) AS BIGINT) AS picks FROM events GROUP BY ALL""")
def first_per_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pick of each kind in a room."""
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 12).alias("room"), "event_type").agg(F.min("event_id").alias("first_pick"), F.count("*").alias("picks"))


@query(f"WITH {_P}" + """ SELECT player, round(points / 100 * CASE WHEN points / 100 >= 23 THEN 0.80 WHEN points / 100 >= 18 THEN 0.87 WHEN points / 100 >= 12 THEN 0.92 ELSE 1 END + 1e-9, 6) AS shrunk, round(CASE WHEN position IN ('Brand#1', 'Brand#2') THEN 0.5 * points + 0.5 * p_size * 20 WHEN position = 'Brand#3' THEN 0.7 * points + 0.3 * p_size * 20 ELSE points END + 1e-9, 4) AS blended FROM p""")
def shrink_and_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shrink ladder, and a blend with a second source by position where it is present."""
    x = F.col("points") / 100
    ladder = reduce(lambda c, s: F.when(x >= s[0], F.lit(s[1])).otherwise(c), ((12.0, 0.92), (18.0, 0.87), (23.0, 0.80)), F.lit(1.0))
    other = F.col("p_size") * 20
    blend = lambda w: (1 - w) * F.col("points") + w * other
    b = F.when(F.col("position").isin("Brand#1", "Brand#2"), blend(0.5)).when(F.col("position") == "Brand#3", blend(0.3)).otherwise(F.col("points"))
    return boards(spark, sf_dir).select("player", fixed(x * ladder).alias("shrunk"), fixed(b, 4).alias("blended"))


@query(f"WITH {_P}" + """, z AS (SELECT *, greatest(least((p_size - avg(p_size) OVER g) / nullif(stddev_samp(p_size) OVER g, 0), 3), -3) AS z, count(*) OVER g AS n FROM p WINDOW g AS (PARTITION BY position)), s AS (SELECT player, position, round(greatest(points / 100 + greatest(least(0.6 * CASE WHEN n >= 3 THEN coalesce(z, 0) ELSE 0 END, NUDGE), -NUDGE), 0) + 1e-9, 4) AS score FROM z)
SELECT player, position, score, CAST(row_number() OVER (PARTITION BY position ORDER BY score DESC, player) AS BIGINT) AS rk FROM s""".replace("NUDGE", str(NUDGE_CAP)))
def ranking_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points moved by a capped nudge from the z-score, never below 0; the final rank is made of that."""
    z = F.coalesce(W.zscore("p_size", "position"), F.lit(0.0))
    s = boards(spark, sf_dir).select("player", "position", fixed(F.greatest(F.col("points") / 100 + clip(0.6 * z, -NUDGE_CAP, NUDGE_CAP), F.lit(0.0)), 4).alias("score"))
    return s.withColumn("rk", F.row_number().over(Window.partitionBy("position").orderBy(F.desc("score"), "player")).cast("long"))

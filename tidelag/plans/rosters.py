"""Rosters: differences, byes, outer and fallback joins, vacated shares, latest snapshots, edges, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelag.functions import windows as W
from tidelag.functions.scalars import clip, fixed, ratio
from tidelag.operators.joins import coverage, departures_arrivals, fallback
from tidelag.plans.inputs import games, plays, query
from tidelag.sources.sinks import latest_rows, merged_edges, upserted
from tidelag.sources.tables import table

_ROSTER = """r AS (SELECT player, season, team FROM (SELECT player, season, team, row_number() OVER (PARTITION BY player, season ORDER BY count(*) DESC, team) AS i FROM plays GROUP BY player, season, team) WHERE i = 1)"""


def rosters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """player, season, team: the team with most plays, the smallest on ties."""
    n = plays(spark, sf_dir).groupBy("player", "season", "team").agg(F.count("*").alias("n"))
    return n.groupBy("player", "season").agg(F.max(F.struct("n", (-F.col("team")).alias("t"))).alias("b")).select("player", "season", (-F.col("b.t")).alias("team"))


def neighbours(r: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of every season but the last, told as of the season after, and rows of every season but the first."""
    r = r.join(F.broadcast(r.agg(F.min("season").alias("first"), F.max("season").alias("last"))), how="cross")
    return r.where("season < last").withColumn("season", F.col("season") + 1).drop("first", "last"), r.where("season > first").drop("first", "last")


@query("WITH {plays}, " + _ROSTER + """, b AS (SELECT player, season + 1 AS season, team FROM r WHERE season < (SELECT max(season) FROM r)), a AS (SELECT * FROM r WHERE season > (SELECT min(season) FROM r))
SELECT player, season, b.team AS left_group, a.team AS joined_group FROM b FULL JOIN a USING (player, season) WHERE b.team IS DISTINCT FROM a.team""")
def roster_diff_anti_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who left, joined or moved from each season to the next."""
    return departures_arrivals(*neighbours(rosters(spark, sf_dir)), ("player", "season"), "team")


@query("""WITH {games}, a AS (SELECT season, week, home AS club FROM games UNION SELECT season, week, away FROM games), c AS (SELECT DISTINCT season, week FROM games), k AS (SELECT unnest(range(0, 40)) AS club)
SELECT season, week, club FROM c, k EXCEPT SELECT season, week, club FROM a""")
def bye_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clubs that do not play in a week: the small spine of clubs and weeks less those seen."""
    g = games(spark, sf_dir).select("season", "week", F.explode(F.array("home", "away")).alias("club")).distinct()
    spine = g.select("season", "week").distinct().withColumn("club", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(39).cast("long"))))
    return spine.join(g, ["season", "week", "club"], "left_anti")


@query("""WITH a AS (SELECT CASE WHEN p_size > 5 THEN p_partkey END AS id, p_name AS name FROM part), b AS (SELECT l_partkey AS id, max(l_quantity) AS best FROM lineitem GROUP BY 1)
SELECT id, name, best FROM (SELECT * FROM a WHERE id IS NOT NULL) FULL JOIN b USING (id) UNION ALL SELECT NULL, name, NULL FROM a WHERE id IS NULL""")
def full_outer_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full join on a nullable key; rows without a key are set aside and added again."""
    a = table(spark, sf_dir, "part").select(F.when(F.col("p_size") > 5, F.col("p_partkey")).alias("id"), F.col("p_name").alias("name"))
    b = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.max("l_quantity").alias("best"))
    return a.where("id IS NOT NULL").join(b, "id", "full").unionByName(a.where("id IS NULL"), allowMissingColumns=True)


@query("""SELECT CAST(count_if(r.k IS NULL) AS BIGINT) AS left_only, CAST(count_if(l.k IS NULL) AS BIGINT) AS right_only, CAST(count_if(l.k IS NOT NULL AND r.k IS NOT NULL) AS BIGINT) AS both FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem) l FULL JOIN (SELECT DISTINCT o_orderkey AS k FROM orders) r ON l.k = r.k""")
def coverage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many keys two tables share."""
    return coverage(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), ["k"])


@query("""WITH a AS (SELECT c_custkey AS row_id, CASE WHEN c_custkey % 3 = 0 THEN c_custkey + 1000000 ELSE c_custkey END AS id, 'n' || CAST(c_custkey % 700 AS VARCHAR) AS name FROM customer), b AS (SELECT c_custkey AS id, 'n' || CAST(c_custkey AS VARCHAR) AS name, c_acctbal AS v FROM customer)
SELECT a.row_id, coalesce(x.v, y.v) AS v, CASE WHEN x.id IS NOT NULL THEN 'id' WHEN y.name IS NOT NULL THEN 'name' ELSE 'none' END AS matched_by FROM a LEFT JOIN b x ON a.id = x.id LEFT JOIN b y ON a.name = y.name""")
def multi_key_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actuals by id, else by name."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    a = c.select(k.alias("row_id"), F.when(k % 3 == 0, k + 1000000).otherwise(k).alias("id"), F.concat(F.lit("n"), (k % 700).cast("string")).alias("name"))
    b = c.select(k.alias("id"), F.concat(F.lit("n"), k.cast("string")).alias("name"), F.col("c_acctbal").alias("v"))
    return fallback(a, b, "id", "name", ["v"]).drop("id", "name")


@query("WITH {plays}, " + _ROSTER + """, y AS (SELECT player, season, sum(yards) AS y FROM plays GROUP BY ALL), s AS (SELECT r.*, y / sum(y) OVER (PARTITION BY team, r.season) AS share FROM r JOIN y ON r.player = y.player AND r.season = y.season),
b AS (SELECT player, season + 1 AS season, team, share FROM s WHERE season < (SELECT max(season) FROM s)), a AS (SELECT player, season, team, share FROM s WHERE season > (SELECT min(season) FROM s)),
gone AS (SELECT season, b.team, sum(b.share) AS out FROM b LEFT JOIN a USING (player, season) WHERE (a.team IS NULL OR a.team <> b.team) AND b.share >= 0.02 GROUP BY ALL),
came AS (SELECT season, a.team, sum(b.share) AS inn FROM a JOIN b USING (player, season) WHERE a.team <> b.team GROUP BY ALL), n AS (SELECT season, team, least(greatest(out - coalesce(inn, 0), 0), 1) AS net FROM gone LEFT JOIN came USING (season, team)),
k AS (SELECT season, a.team, player, row_number() OVER (PARTITION BY season, a.team ORDER BY a.share DESC, player) AS i FROM a JOIN b USING (player, season) WHERE a.team = b.team), w AS (SELECT *, CASE i WHEN 1 THEN 1.0 WHEN 2 THEN 0.45 WHEN 3 THEN 0.2 ELSE 0.1 END AS wt FROM k)
SELECT season, team, player, round(wt / sum(wt) OVER (PARTITION BY season, team) * coalesce(net, 0) + 1e-9, 6) AS absorbed, round(least(1 + 0.5 * (wt / sum(wt) OVER (PARTITION BY season, team) * coalesce(net, 0)), 1.2) + 1e-9, 6) AS boost FROM w LEFT JOIN n USING (season, team)""")
def vacated_opportunity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A team's share that left less what came, from each season to the next, dealt to those who stayed by their rank."""
    y = plays(spark, sf_dir).groupBy("player", "season").agg(F.sum("yards").alias("y"))
    s = rosters(spark, sf_dir).join(y, ["player", "season"]).withColumn("share", W.share("y", "team", "season"))
    b, a = (x.select("player", "season", F.col("team").alias(f"team_{n}"), F.col("share").alias(f"share_{n}")) for x, n in zip(neighbours(s), "ba", strict=True))
    m = b.join(a, ["player", "season"], "full")
    moved = ~F.col("team_a").eqNullSafe(F.col("team_b"))
    gone = m.where(moved & (F.col("share_b") >= 0.02)).groupBy("season", F.col("team_b").alias("team")).agg(F.sum("share_b").alias("out"))
    came = m.where("team_a <> team_b").groupBy("season", F.col("team_a").alias("team")).agg(F.sum("share_b").alias("inn"))
    net = gone.join(came, ["season", "team"], "left").select("season", "team", clip(F.col("out") - F.coalesce("inn", F.lit(0.0)), 0, 1).alias("net"))
    i = F.row_number().over(Window.partitionBy("season", "team").orderBy(F.desc("share_a"), "player"))
    k = m.where("team_a = team_b").select("season", F.col("team_a").alias("team"), "player", "share_a").withColumn("i", i)
    k = k.withColumn("wt", F.when(F.col("i") == 1, 1.0).when(F.col("i") == 2, 0.45).when(F.col("i") == 3, 0.2).otherwise(0.1))
    absorbed = W.share("wt", "season", "team") * F.coalesce("net", F.lit(0.0))
    return k.join(net, ["season", "team"], "left").select("season", "team", "player", fixed(absorbed).alias("absorbed"), fixed(F.least(1 + 0.5 * absorbed, F.lit(1.2))).alias("boost"))


@query("""WITH {plays}, d AS (SELECT team, season, week, player, row_number() OVER (PARTITION BY team, season, week ORDER BY sum(yards) DESC, player) AS rk, max(success) = 0 AS out FROM plays GROUP BY team, season, week, player)
SELECT a.team, a.season, a.week, a.player, CAST(a.rk AS BIGINT) AS rk, CAST(coalesce(sum(CASE WHEN b.out THEN 1 ELSE 0 END), 0) AS BIGINT) AS better_out FROM d a LEFT JOIN d b ON a.team = b.team AND a.season = b.season AND a.week = b.week AND b.rk < a.rk GROUP BY ALL""")
def better_teammate_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many better-ranked teammates are out: a running count by rank in place of a theta join."""
    d = plays(spark, sf_dir).groupBy("team", "season", "week", "player").agg(F.sum("yards").alias("y"), (F.max("success") == 0).alias("out"))
    w = Window.partitionBy("team", "season", "week").orderBy(F.desc("y"), "player")
    before = F.coalesce(F.sum(F.col("out").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    return d.select("team", "season", "week", "player", F.row_number().over(w).cast("long").alias("rk"), before.alias("better_out"))


@query("""WITH {plays}, p AS (SELECT team, season, player, sum(yards) AS y, avg(epa) AS e FROM plays GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY team, season ORDER BY y DESC, player) AS i FROM p)
SELECT team, season, round(CASE WHEN sum(y) > 0 THEN sum(e * y) / sum(y) ELSE 0 END + 1e-9, 6) AS quality FROM t WHERE i <= 3 GROUP BY ALL""")
def topk_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of a team's three most used players, weighted by use."""
    p = plays(spark, sf_dir).groupBy("team", "season", "player").agg(F.sum("yards").alias("y"), F.avg("epa").alias("e"))
    top = p.withColumn("i", F.row_number().over(Window.partitionBy("team", "season").orderBy(F.desc("y"), "player"))).where("i <= 3")
    return top.groupBy("team", "season").agg(fixed(ratio(F.sum(F.col("e") * F.col("y")), F.sum("y"), 0.0)).alias("quality"))


@query("""WITH e AS (SELECT user_id, event_type, value, ts, event_id FROM events WHERE ts <= TIMESTAMP '2024-01-05'), l AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) AS i FROM e)
SELECT user_id, event_type, value, slot FROM (SELECT user_id, event_type, value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_type) AS BIGINT) AS slot FROM l WHERE i = 1) WHERE slot <= 2""")
def latest_snapshot_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row of each key up to a time, then the best two of each user."""
    e = table(spark, sf_dir, "events").where("ts <= TIMESTAMP_NTZ '2024-01-05 00:00:00'")
    l = latest_rows(e, ["user_id", "event_type"], [F.desc("ts"), F.asc("event_id")])
    slot = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_type")).cast("long")
    return l.select("user_id", "event_type", "value", slot.alias("slot")).where("slot <= 2")


@query("""WITH {plays}, i AS (SELECT team, season, week, player, CASE max(success) WHEN 0 THEN 0.5 ELSE 0.15 END AS lost FROM plays WHERE yards < 3 GROUP BY ALL), u AS (SELECT team, season, player, sum(yards) / 100 AS w FROM plays WHERE kind = 'pass' GROUP BY ALL)
SELECT i.team, i.season, i.week, round(sum(lost * coalesce(w, 1)) + 1e-9, 6) AS impact, CAST(count(*) AS BIGINT) AS hurt FROM i LEFT JOIN u USING (team, season, player) GROUP BY ALL""")
def usage_weighted_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a team misses by injuries, weighted by use; unknown use weighs 1."""
    p = plays(spark, sf_dir)
    i = p.where("yards < 3").groupBy("team", "season", "week", "player").agg(F.when(F.max("success") == 0, 0.5).otherwise(0.15).alias("lost"))
    u = p.where("kind = 'pass'").groupBy("team", "season", "player").agg((F.sum("yards") / 100).alias("w"))
    j = i.join(u, ["team", "season", "player"], "left")
    return j.groupBy("team", "season", "week").agg(fixed(F.sum(F.col("lost") * F.coalesce("w", F.lit(1.0)))).alias("impact"), F.count("*").alias("hurt"))


@query("""WITH {plays} SELECT player AS src, opp AS dst, season, week, round(sum(yards) + 1e-9, 4) AS weight, CAST(count(*) AS BIGINT) AS n FROM plays GROUP BY ALL""")
def edge_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of players to defences, each key once."""
    e = plays(spark, sf_dir).select(F.col("player").alias("src"), F.col("opp").alias("dst"), "season", "week", F.col("yards").alias("weight"))
    return merged_edges(e).withColumn("weight", fixed("weight", 4))


@query("""WITH s AS (SELECT c_custkey AS id, c_acctbal AS v, 0 AS version, 0 AS fresh FROM customer), c AS (SELECT o_custkey AS id, max(o_totalprice) AS v, 1 AS version, 1 AS fresh FROM orders GROUP BY 1), u AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC, fresh DESC) AS i FROM (SELECT * FROM s UNION ALL SELECT * FROM c)) SELECT id, v, version FROM u WHERE i = 1""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows with changes applied by key."""
    s = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"), F.lit(0).alias("version"))
    c = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("v")).withColumn("version", F.lit(1))
    return upserted(s, c, ["id"], "version")


@query("""WITH d AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events) SELECT user_id, event_id, event_type, value FROM d WHERE i = 1""")
def dedupe_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last event, as one aggregate that combines before the shuffle."""
    best = F.max(F.struct("ts", "event_id", "event_type", "value")).alias("b")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(best).select("user_id", "b.event_id", "b.event_type", "b.value")


@query("""WITH w AS (SELECT p_partkey AS player, unnest(str_split(p_name, ' ')) AS word, p_size FROM part) SELECT word, CAST(count(DISTINCT player) AS BIGINT) AS players, CAST(sum(p_size) AS BIGINT) AS size FROM w GROUP BY word""")
def explode_delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delimited list to rows, then counts."""
    w = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("player"), F.explode(F.split("p_name", " ")).alias("word"), "p_size")
    return w.groupBy("word").agg(F.countDistinct("player").alias("players"), F.sum("p_size").alias("size"))

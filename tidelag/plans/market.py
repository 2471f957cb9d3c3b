"""Odds, props, lines and bets, from games and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelag.functions.scalars import american_probability, bucket, devig, fixed, implied_mean, ladder_mean, ratio
from tidelag.plans.inputs import games, query
from tidelag.sources.sinks import latest_rows
from tidelag.sources.tables import table

_PRED = """p AS (SELECT game, season, home_score - away_score AS margin, spread, home % 4 AS tier, CAST(game * 13 % 41 - 20 AS DOUBLE) / 2 AS predicted, spread + (game % 9 - 4) * 0.5 AS closed FROM games)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.col("game")
    return games(spark, sf_dir).select("game", "season", (F.col("home_score") - F.col("away_score")).alias("margin"), "spread", ((g * 13 % 41 - 20).cast("double") / 2).alias("predicted"), (F.col("spread") + (g % 9 - 4) * 0.5).alias("closed"))


@query("""WITH o AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 100 + o_custkey % 200 ELSE -100 - o_custkey % 200 END AS a, -110 AS b FROM orders),
p AS (SELECT id, CASE WHEN a > 0 THEN 100.0 / (a + 100.0) ELSE -a / (-a + 100.0) END AS pa, 110.0 / 210.0 AS pb FROM o) SELECT id, round(pa + 1e-9, 6) AS implied, round(pa / (pa + pb) + 1e-9, 6) AS fair, round(-ln(1 - pa) + 1e-9, 6) AS anytime_mean FROM p""")
def odds_devig(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of American odds, fair ones of a pair, and the Poisson mean of at least one."""
    k = F.col("o_custkey") % 200
    a = F.when(F.col("o_orderkey") % 2 == 0, 100 + k).otherwise(-100 - k)
    pa, pb = american_probability(a), american_probability(F.lit(-110))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), fixed(pa).alias("implied"), fixed(devig(pa, pb)).alias("fair"), fixed(-F.log1p(-pa)).alias("anytime_mean"))


_Q = "sqrt(-2 * ln(least(q, 1 - q)))"


@query(f"""WITH p AS (SELECT p_partkey AS player, p_retailprice / 100 AS line, (p_size % 9 + 1) / 10.0 AS q FROM part), z AS (SELECT *, (CASE WHEN q < 0.5 THEN -1 ELSE 1 END) * ({_Q} - (2.515517 + {_Q} * (0.802853 + {_Q} * 0.010328)) / (1 + {_Q} * (1.432788 + {_Q} * (0.189269 + {_Q} * 0.001308)))) AS z FROM p)
SELECT player, round(line / greatest(1 - 0.3 * greatest(least(z, 1), -1), 0.1) + 1e-9, 4) AS implied_mean FROM z""")
def implied_mean_from_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean behind a line and the over's fair chance."""
    line = F.col("p_retailprice") / 100
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("player"), fixed(implied_mean(line, (F.col("p_size") % 9 + 1) / 10.0, 0.3), 4).alias("implied_mean"))


@query("""WITH e AS (SELECT user_id, event_type AS market, CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS book, value, ts, event_id FROM events),
l AS (SELECT *, row_number() OVER (PARTITION BY user_id, market, book ORDER BY ts DESC, event_id DESC) AS i FROM e), m AS (SELECT user_id, market, median(value) AS v FROM l WHERE i = 1 GROUP BY ALL),
p AS (SELECT user_id, max(v) FILTER (market = 'click') AS click, max(v) FILTER (market = 'view') AS view, max(v) FILTER (market = 'purchase') AS purchase FROM m GROUP BY ALL)
SELECT user_id, round(click + 1e-9, 4) AS click, round(view + 1e-9, 4) AS view, round(purchase + 1e-9, 4) AS purchase, round(coalesce(click, 0) * 0.5 + coalesce(view, 0) * 0.1 + coalesce(purchase, 0) * 6 + 1e-9, 2) AS points FROM p""")
def market_pivot_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest price of each book, median per market, markets to columns, score."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("market"), (F.get_json_object("props", "$.k").cast("long") % 5).alias("book"), "value", "ts", "event_id")
    l = latest_rows(e, ["user_id", "market", "book"], [F.desc("ts"), F.desc("event_id")])
    names = ["click", "view", "purchase"]
    p = l.groupBy("user_id").agg(*[F.percentile(F.when(F.col("market") == n, F.col("value")), 0.5).alias(n) for n in names])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return p.select("user_id", *[fixed(n, 4).alias(n) for n in names], fixed(zero("click") * 0.5 + zero("view") * 0.1 + zero("purchase") * 6, 2).alias("points"))


@query("""SELECT user_id, list_sort(list(DISTINCT event_type)) AS markets, CAST(count(DISTINCT event_type) AS BIGINT) AS n, count(DISTINCT event_type) FILTER (event_type IN ('click', 'view')) = 2 AS core FROM events GROUP BY user_id""")
def book_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The set of markets of each key and whether the core ones are all in it."""
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("markets"))
    core = F.size(F.array_except(F.array(F.lit("click"), F.lit("view")), "markets")) == 0
    return s.select("user_id", "markets", F.size("markets").cast("long").alias("n"), core.alias("core"))


@query("WITH {games}, " + _PRED + """, b AS (SELECT *, CASE WHEN predicted = spread OR margin = spread THEN 'push' WHEN (predicted > spread) = (margin > spread) THEN 'win' ELSE 'loss' END AS outcome, abs(predicted - spread) AS edge FROM p),
t AS (SELECT season, CASE WHEN edge <= 1.5 THEN 'low' WHEN edge <= 3 THEN 'medium' ELSE 'high' END AS edge_tier, count_if(outcome = 'win') AS w, count_if(outcome = 'loss') AS l FROM b GROUP BY ALL)
SELECT season, edge_tier, CAST(w AS BIGINT) AS wins, CAST(l AS BIGINT) AS losses, round(w * (100.0 / 110.0) - l + 1e-9, 4) AS profit, round(CASE WHEN w + l > 0 THEN (w * (100.0 / 110.0) - l) / (w + l) * 100 END + 1e-9, 4) AS roi FROM t""")
def ats_profit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bets against the spread by edge: wins, losses, profit at -110 and its rate; pushes stay out."""
    p = predictions(spark, sf_dir).withColumn("edge", F.abs(F.col("predicted") - F.col("spread")))
    push = (F.col("predicted") == F.col("spread")) | (F.col("margin") == F.col("spread"))
    right = (F.col("predicted") > F.col("spread")) == (F.col("margin") > F.col("spread"))
    t = p.withColumn("edge_tier", bucket("edge", (-1, 1.5, 3, 1e9), ("low", "medium", "high"))).groupBy("season", "edge_tier").agg(F.count_if(~push & right).alias("wins"), F.count_if(~push & ~right).alias("losses"))
    profit = F.col("wins") * (100.0 / 110.0) - F.col("losses")
    return t.select("season", "edge_tier", "wins", "losses", fixed(profit, 4).alias("profit"), fixed(ratio(profit, F.col("wins") + F.col("losses")) * 100, 4).alias("roi"))


@query("WITH {games}, " + _PRED + """, c AS (SELECT season, CASE WHEN predicted > spread THEN closed - spread ELSE spread - closed END AS captured FROM p)
SELECT season, round(avg(captured) + 1e-9, 6) AS captured, round(avg(CASE WHEN captured > 0 THEN 1.0 ELSE 0.0 END) + 1e-9, 6) AS beat_rate, round(stddev_pop(captured) + 1e-9, 6) AS spread_of FROM c GROUP BY ALL""")
def clv_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movement of the closing line towards the bet, by season."""
    c = F.when(F.col("predicted") > F.col("spread"), F.col("closed") - F.col("spread")).otherwise(F.col("spread") - F.col("closed"))
    p = predictions(spark, sf_dir).withColumn("captured", c)
    return p.groupBy("season").agg(fixed(F.avg("captured")).alias("captured"), fixed(F.avg(F.when(F.col("captured") > 0, 1.0).otherwise(0.0))).alias("beat_rate"), fixed(F.stddev_pop("captured")).alias("spread_of"))


@query("""WITH e AS (SELECT user_id % 40 AS match, user_id AS book, ts, value, event_id FROM events WHERE ts < TIMESTAMP '2024-01-20' + (user_id % 40) * INTERVAL 1 HOUR),
b AS (SELECT match, book, min_by(value, ts) AS opened, max_by(value, ts) AS closed, count(*) AS n FROM e GROUP BY ALL)
SELECT match, round(median(opened) + 1e-9, 4) AS opened, round(median(closed) + 1e-9, 4) AS closed, CAST(count(*) AS BIGINT) AS books, CAST(sum(n) AS BIGINT) AS snapshots FROM b GROUP BY ALL""")
def open_close_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each book's first and last value before the start, then the median over books; late rows drop out."""
    start = F.lit("2024-01-20").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.col("user_id") % 40).cast("int"))
    e = table(spark, sf_dir, "events").where(F.col("ts") < start).withColumn("match", F.col("user_id") % 40)
    b = e.groupBy("match", "user_id").agg(F.min_by("value", "ts").alias("opened"), F.max_by("value", "ts").alias("closed"), F.count("*").alias("n"))
    return b.groupBy("match").agg(fixed(F.percentile("opened", 0.5), 4).alias("opened"), fixed(F.percentile("closed", 0.5), 4).alias("closed"), F.count("*").alias("books"), F.sum("n").alias("snapshots"))


_TAIL = "(exp(-z * z / 2) / sqrt(2 * pi()) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))))"


@query(f"""WITH s AS (SELECT DISTINCT p_size FROM part), l AS (SELECT p_size, unnest([10.0, 20.0, 40.0]) AS m FROM s), p AS (SELECT p_size, m, exp(-m / (p_size + 5.0)) AS prob FROM l), g AS (SELECT unnest(range(1, 8001)) / 100.0 AS mean),
z AS (SELECT *, (m - mean) / (0.3 * mean) AS z, 1 / (1 + 0.2316419 * abs((m - mean) / (0.3 * mean))) AS t FROM p, g), e AS (SELECT p_size, mean, sum((CASE WHEN z >= 0 THEN {_TAIL} ELSE 1 - {_TAIL} END - prob) ** 2) AS err FROM z GROUP BY ALL), y AS (SELECT p_size, min_by(mean, err) AS yards, min(err) AS yards_err FROM e GROUP BY p_size),
q AS (SELECT p_size, mean, (1 - exp(-mean) - exp(-1 / (p_size % 5 + 1.0))) ** 2 + (1 - exp(-mean) * (1 + mean) - exp(-2 / (p_size % 5 + 1.0))) ** 2 + (1 - exp(-mean) * (1 + mean + mean * mean / 2) - exp(-3 / (p_size % 5 + 1.0))) ** 2 AS err FROM s, g WHERE mean <= 6), c AS (SELECT p_size, min_by(mean, err) AS scores FROM q GROUP BY p_size)
SELECT p_partkey AS player, round(yards + 1e-9, 4) AS yards, round(yards_err + 1e-9, 6) AS yards_err, round(scores + 1e-9, 4) AS scores FROM part JOIN y ON part.p_size = y.p_size JOIN c ON part.p_size = c.p_size""")
def ladder_inversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The means whose milestone chances fit best, of a normal stat and of a count; each different ladder is searched once."""
    size = F.col("p_size")
    yards = ladder_mean((10, 20, 40), [F.exp(-m / (size + 5.0)) for m in (F.lit(10.0), F.lit(20.0), F.lit(40.0))], 0.3)
    scores = ladder_mean((1, 2, 3), [F.exp(-m / (size % 5 + 1.0)) for m in (F.lit(1.0), F.lit(2.0), F.lit(3.0))])
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("player"), "p_size")
    fits = p.select("p_size").where("p_size IS NOT NULL").distinct().repartition("p_size").select("p_size", yards.alias("y"), scores.alias("s"))
    return p.join(fits, "p_size").select("player", fixed("y.mean", 4).alias("yards"), fixed("y.err").alias("yards_err"), fixed("s.mean", 4).alias("scores"))

"""Data quality checks, leaderboards and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelag.functions.scalars import fixed
from tidelag.plans.inputs import games, plays, query
from tidelag.sources.tables import table


@query("""WITH c AS (SELECT count(*) AS n, count(DISTINCT doc_id) AS ids, avg(CASE WHEN text IS NULL THEN 1.0 ELSE 0.0 END) AS a, avg(CASE WHEN lang IS NULL THEN 1.0 ELSE 0.0 END) AS b, avg(CASE WHEN source IS NULL THEN 1.0 ELSE 0.0 END) AS c, count_if(n_chars < 0) AS neg FROM documents)
SELECT CAST(n AS BIGINT) AS n_rows, CAST(n - ids AS BIGINT) AS duplicate_ids, round(a + 1e-9, 6) AS null_text, round(b + 1e-9, 6) AS null_lang, round(c + 1e-9, 6) AS null_source, CAST(neg AS BIGINT) AS negatives, greatest(a, b, c) <= 0.1 AND n = ids AND neg = 0 AS passed FROM c""")
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null shares, duplicate keys and negative values of a table in one aggregation."""
    null = lambda c: F.avg(F.when(F.col(c).isNull(), 1.0).otherwise(0.0))
    c = table(spark, sf_dir, "documents").agg(F.count("*").alias("n_rows"), F.countDistinct("doc_id").alias("ids"), *[null(x).alias(f"null_{x}") for x in ("text", "lang", "source")], F.count_if(F.col("n_chars") < 0).alias("negatives"))
    shares = [F.col(f"null_{x}") for x in ("text", "lang", "source")]
    ok = (F.greatest(*shares) <= 0.1) & (F.col("n_rows") == F.col("ids")) & (F.col("negatives") == 0)
    return c.select("n_rows", (F.col("n_rows") - F.col("ids")).alias("duplicate_ids"), *[fixed(s).alias(f"null_{x}") for s, x in zip(shares, ("text", "lang", "source"), strict=True)], "negatives", ok.alias("passed"))


@query("""WITH r AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rk, p_size FROM part), k AS (SELECT p_brand, rk - lag(rk) OVER (PARTITION BY p_brand ORDER BY rk) AS gap FROM r WHERE p_size > 20) SELECT p_brand, CAST(max(gap) AS BIGINT) AS max_gap FROM k GROUP BY p_brand""")
def rank_gap_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest hole in the ranks of those kept."""
    g = Window.partitionBy("p_brand")
    r = table(spark, sf_dir, "part").select("p_brand", "p_size", F.row_number().over(g.orderBy(F.desc("p_retailprice"), "p_partkey")).cast("long").alias("rk")).where("p_size > 20")
    k = r.select("p_brand", (F.col("rk") - F.lag("rk").over(g.orderBy("rk"))).alias("gap"))
    return k.groupBy("p_brand").agg(F.max("gap").alias("max_gap"))


@query("""WITH r AS (SELECT p_brand, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rk FROM part), m AS (SELECT p_brand, avg(p_retailprice) AS top_mean FROM r WHERE rk <= 24 GROUP BY ALL) SELECT p_brand, round(top_mean + 1e-9, 4) AS top_mean, top_mean BETWEEN 900 AND 1200 AS inside FROM m""")
def top_band_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the top 24 against a band."""
    r = table(spark, sf_dir, "part").withColumn("rk", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))).where("rk <= 24")
    m = r.groupBy("p_brand").agg(F.avg("p_retailprice").alias("m"))
    return m.select("p_brand", fixed("m", 4).alias("top_mean"), F.col("m").between(900, 1200).alias("inside"))


@query("""SELECT o_custkey AS player, round(sum(o_totalprice) + 1e-9, 2) AS total, CAST(count(*) AS BIGINT) AS games FROM orders GROUP BY 1 HAVING count(*) >= 5 ORDER BY total DESC, player LIMIT 50""")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Season leaders with a least number of games: a top-50 report."""
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("player")).agg(fixed(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("games"))
    return g.where("games >= 5").orderBy(F.desc("total"), "player").limit(50)


@query("""WITH {plays}, a AS (SELECT DISTINCT team FROM plays WHERE kind = 'pass' AND yards > 48), b AS (SELECT DISTINCT opp AS team FROM plays WHERE kind = 'run' AND yards > 49) SELECT 'both' AS op, team FROM (SELECT team FROM a INTERSECT SELECT team FROM b) UNION ALL SELECT 'only_a', team FROM (SELECT team FROM a EXCEPT SELECT team FROM b) UNION ALL SELECT 'any', team FROM (SELECT team FROM a UNION SELECT team FROM b)""")
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection, difference and union of two sets of teams."""
    p = plays(spark, sf_dir)
    a, b = p.where("kind = 'pass' AND yards > 48").select("team"), p.where("kind = 'run' AND yards > 49").select(F.col("opp").alias("team"))
    named = lambda d, n: d.select(F.lit(n).alias("op"), "team")
    return named(a.intersect(b), "both").union(named(a.subtract(b), "only_a")).union(named(a.union(b).distinct(), "any"))


@query("""WITH d AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS i FROM orders), f AS (SELECT * FROM d WHERE i = 1)
SELECT o_custkey AS player, max(o_totalprice) FILTER (o_orderpriority = '1-URGENT') AS urgent, max(o_totalprice) FILTER (o_orderpriority = '2-HIGH') AS high, max(o_totalprice) FILTER (o_orderpriority = '5-LOW') AS low FROM f GROUP BY ALL""")
def pivot_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first value of each kind as columns."""
    first = F.min(F.struct("o_orderdate", "o_orderkey", "o_totalprice")).alias("f")
    f = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("player"), "o_orderpriority").agg(first)
    kinds = {"1-URGENT": "urgent", "2-HIGH": "high", "5-LOW": "low"}
    return f.groupBy("player").agg(*[F.max(F.when(F.col("o_orderpriority") == k, F.col("f.o_totalprice"))).alias(n) for k, n in kinds.items()])


@query("""WITH {games}, a AS (SELECT DISTINCT home, season FROM games) SELECT s.season, CAST(count(a.home) AS BIGINT) AS present, CAST(32 - count(a.home) AS BIGINT) AS missing FROM (SELECT unnest(range(1994, 2004)) AS season) s LEFT JOIN a ON s.season = a.season GROUP BY ALL""")
def season_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clubs seen per season against what is expected."""
    a = games(spark, sf_dir).select("home", "season").distinct()
    s = spark.range(1994, 2004).select(F.col("id").alias("season"))
    return s.join(a, "season", "left").groupBy("season").agg(F.count("home").alias("present"), (32 - F.count("home")).alias("missing"))


@query("""WITH o AS (SELECT p_partkey, p_brand, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rk FROM part QUALIFY rk <= 50) SELECT p_partkey, p_brand AS ours, 'Brand#' || CAST(p_partkey % 25 + 1 AS VARCHAR) AS theirs FROM o WHERE p_brand <> 'Brand#' || CAST(p_partkey % 25 + 1 AS VARCHAR)""")
def drift_top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top rows whose group differs from the other source's: a top-50 report."""
    o = table(spark, sf_dir, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(50)
    theirs = F.concat(F.lit("Brand#"), (F.col("p_partkey") % 25 + 1).cast("string"))
    return o.select("p_partkey", F.col("p_brand").alias("ours"), theirs.alias("theirs")).where("ours <> theirs")


@query("""SELECT n_regionkey AS region, NTILE(4) OVER (ORDER BY s_acctbal, s_suppkey) AS quartile, s_suppkey, CAST(50 + (100 - rank() OVER (ORDER BY s_acctbal DESC)) * 49 // 99 AS BIGINT) AS rating FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def quartile_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal-depth buckets and ranks as ratings of the supplier table, which is a dimension."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("region"))
    s = table(spark, sf_dir, "supplier").join(n, "s_nationkey")
    r = F.rank().over(Window.orderBy(F.desc("s_acctbal")))
    return s.select("region", F.ntile(4).over(Window.orderBy("s_acctbal", "s_suppkey")).cast("long").alias("quartile"), "s_suppkey", (50 + F.call_function("div", (100 - r) * 49, F.lit(99))).cast("long").alias("rating"))

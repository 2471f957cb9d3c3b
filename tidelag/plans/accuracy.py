"""Evaluation: errors, correlations, hit rates, intervals, accuracy gaps, fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelag.functions import windows as W
from tidelag.functions.scalars import fixed, ratio
from tidelag.plans.inputs import query
from tidelag.sources.tables import table

_E = "e AS (SELECT l_orderkey AS game, l_suppkey % 5 AS position, CAST(year(l_shipdate) AS BIGINT) AS season, l_quantity AS actual, l_quantity * 0.6 + l_partkey % 23 AS projected, 20.0 + l_partkey % 11 AS rival FROM lineitem)"


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("game"), (F.col("l_suppkey") % 5).alias("position"), F.year("l_shipdate").cast("long").alias("season"),
        F.col("l_quantity").alias("actual"), (F.col("l_quantity") * 0.6 + p % 23).alias("projected"), (20.0 + p % 11).alias("rival"),
    )


@query(f"WITH {_E}" + """ SELECT CASE WHEN grouping(position) = 1 THEN 'OVERALL' ELSE CAST(position AS VARCHAR) END AS position, CAST(count(*) AS BIGINT) AS n, round(avg(abs(projected - actual)) + 1e-9, 6) AS mae, round(sqrt(avg((projected - actual) ** 2)) + 1e-9, 6) AS rmse, round(avg(projected - actual) + 1e-9, 6) AS bias, round(avg(abs(projected - actual)) - avg(abs(rival - actual)) + 1e-9, 6) AS gap FROM e GROUP BY GROUPING SETS ((position), ())""")
def mae_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by position with a total row, in one aggregation."""
    d, r = F.col("projected") - F.col("actual"), F.col("rival") - F.col("actual")
    name = F.when(F.grouping("position") == 1, "OVERALL").otherwise(F.col("position").cast("string"))
    g = errors(spark, sf_dir).rollup("position").agg(name.alias("name"), F.count("*").alias("n"), fixed(F.avg(F.abs(d))).alias("mae"), fixed(F.sqrt(F.avg(d * d))).alias("rmse"), fixed(F.avg(d)).alias("bias"), fixed(F.avg(F.abs(d)) - F.avg(F.abs(r))).alias("gap"))
    return g.drop("position").withColumnRenamed("name", "position")


@query(f"WITH {_E}" + """, a AS (SELECT game, position, season, avg(actual) AS actual, round(avg(projected) + 1e-9, 6) AS projected FROM e GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY position, season ORDER BY actual) + (count(*) OVER (PARTITION BY position, season, actual) - 1) / 2 AS ra, rank() OVER (PARTITION BY position, season ORDER BY projected) + (count(*) OVER (PARTITION BY position, season, projected) - 1) / 2 AS rp FROM a),
c AS (SELECT position, season, corr(ra, rp) AS rho FROM r GROUP BY ALL HAVING count(*) >= 10) SELECT position, round(avg(rho) + 1e-9, 6) AS spearman, CAST(count(*) AS BIGINT) AS seasons FROM c GROUP BY position""")
def spearman_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation by position and season, averaged over seasons of ten rows or more."""
    a = errors(spark, sf_dir).groupBy("game", "position", "season").agg(F.avg("actual").alias("actual"), fixed(F.avg("projected")).alias("projected"))
    r = W.with_rank_averages(a, ("position", "season"), {"actual": "ra", "projected": "rp"})
    c = r.groupBy("position", "season").agg(F.corr("ra", "rp").alias("rho"), F.count("*").alias("n")).where("n >= 10")
    return c.groupBy("position").agg(fixed(F.avg("rho")).alias("spearman"), F.count("*").alias("seasons"))


@query(f"WITH {_E}" + """, a AS (SELECT game, position, round(sum(actual) + 1e-9, 4) AS actual, round(sum(projected) + 1e-9, 4) AS projected FROM e GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY actual DESC, game) AS x, row_number() OVER (PARTITION BY position ORDER BY projected DESC, game) AS y FROM a)
SELECT position, CAST(count_if(x <= 50 AND y <= 50) AS BIGINT) AS hits, round(count_if(x <= 50 AND y <= 50) / count_if(x <= 50) + 1e-9, 6) AS hit_rate FROM r GROUP BY position""")
def topn_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the real top 50 the projected top 50 holds."""
    a = errors(spark, sf_dir).groupBy("game", "position").agg(fixed(F.sum("actual"), 4).alias("actual"), fixed(F.sum("projected"), 4).alias("projected"))
    # Each side's top is cut by itself, of which every task keeps 50 rows a position before the shuffle.
    top = lambda c, x, y: a.withColumn("i", F.row_number().over(Window.partitionBy("position").orderBy(F.desc(c), "game"))).where("i <= 50").select("position", "game", F.lit(x).alias("x"), F.lit(y).alias("y"))
    r = top("actual", 1, 0).unionByName(top("projected", 0, 1)).groupBy("position", "game").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    hit = F.count_if((F.col("x") == 1) & (F.col("y") == 1))
    return r.groupBy("position").agg(hit.alias("hits"), fixed(hit / F.count_if(F.col("x") == 1)).alias("hit_rate"))


@query(f"WITH {_E}" + """ SELECT position, round(avg(greatest(0.1 * (actual - projected * 0.7), -0.9 * (actual - projected * 0.7))) + 1e-9, 6) AS pinball10, round(avg(greatest(0.9 * (actual - projected * 1.3), -0.1 * (actual - projected * 1.3))) + 1e-9, 6) AS pinball90,
  round(avg(CASE WHEN actual BETWEEN projected * 0.7 AND projected * 1.3 THEN 1.0 ELSE 0.0 END) + 1e-9, 6) AS coverage, round(avg(projected * 0.6) + 1e-9, 6) AS width FROM e GROUP BY position""")
def pinball_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pinball losses of two quantiles, coverage and width of the band between."""
    low, high, a = F.col("projected") * 0.7, F.col("projected") * 1.3, F.col("actual")
    loss = lambda q, x: fixed(F.avg(F.greatest(q * (a - x), (q - 1) * (a - x))))
    return errors(spark, sf_dir).groupBy("position").agg(loss(0.1, low).alias("pinball10"), loss(0.9, high).alias("pinball90"), fixed(F.avg(F.when(a.between(low, high), 1.0).otherwise(0.0))).alias("coverage"), fixed(F.avg(F.col("projected") * 0.6)).alias("width"))


@query(f"WITH {_E}" + """, f AS (SELECT unnest(range(0, 11)) AS k), c AS (SELECT position, k, avg(CASE WHEN abs(actual - projected) <= (1 + 0.25 * k) * 4 THEN 1.0 ELSE 0.0 END) AS cov FROM e, f GROUP BY ALL) SELECT position, min(1 + 0.25 * k) FILTER (cov >= 0.8) AS factor FROM c GROUP BY position""")
def conformal_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of eleven width factors whose band covers 80%: eleven sums in one pass, rows are not multiplied."""
    miss = F.abs(F.col("actual") - F.col("projected"))
    grid = [1 + 0.25 * k for k in range(11)]
    c = errors(spark, sf_dir).groupBy("position").agg(*[F.avg(F.when(miss <= f * 4, 1.0).otherwise(0.0)).alias(f"c{k}") for k, f in enumerate(grid)])
    first = F.coalesce(*[F.when(F.col(f"c{k}") >= 0.8, F.lit(f)) for k, f in enumerate(grid)])
    return c.select("position", first.alias("factor"))


@query(f"WITH {_E}" + """, a AS (SELECT position, season, game, round(sum(actual) + 1e-9, 4) AS actual, round(sum(projected) + 1e-9, 4) AS projected FROM e GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY position, season ORDER BY actual DESC, game) AS ar, row_number() OVER (PARTITION BY position, season ORDER BY projected DESC, game) AS pr FROM a),
b AS (SELECT position, season, ar AS place, actual AS baseline, count(*) OVER (PARTITION BY position, season) AS most FROM r) SELECT r.position, r.season, r.game, round(abs(b.baseline - r.actual) + 1e-9, 4) AS gap FROM r JOIN b ON r.position = b.position AND r.season = b.season AND b.place = least(r.pr, b.most) WHERE r.pr <= 40 OR r.ar <= 40""")
def accuracy_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each real value from what its projected rank is worth in its season, for the top by either."""
    a = errors(spark, sf_dir).groupBy("position", "season", "game").agg(fixed(F.sum("actual"), 4).alias("actual"), fixed(F.sum("projected"), 4).alias("projected"))
    g = Window.partitionBy("position", "season")
    r = a.select("*", *[F.row_number().over(g.orderBy(F.desc(c), "game")).alias(n) for c, n in (("actual", "ar"), ("projected", "pr"))])
    b = r.select("position", "season", F.col("ar").alias("pr"), F.col("actual").alias("baseline"))
    return r.where("pr <= 40 OR ar <= 40").join(b, ["position", "season", "pr"]).select("position", "season", "game", fixed(F.abs(F.col("baseline") - F.col("actual")), 4).alias("gap"))


@query("""SELECT p_brand AS position, round(regr_slope(p_size, log10(p_retailprice)) + 1e-9, 4) AS slope, round(regr_intercept(p_size, log10(p_retailprice)) + 1e-9, 4) AS intercept, round(corr(p_size, p_retailprice) + 1e-9, 6) AS r FROM part GROUP BY ALL""")
def log_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear fit on a logarithm, by position."""
    x, y = F.log10("p_retailprice"), F.col("p_size")
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("position")).agg(fixed(F.regr_slope(y, x), 4).alias("slope"), fixed(F.regr_intercept(y, x), 4).alias("intercept"), fixed(F.corr(y, F.col("p_retailprice"))).alias("r"))


@query("""WITH m AS (SELECT corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, l_discount) AS b, corr(l_quantity, l_tax) AS c, corr(l_extendedprice, l_discount) AS d, corr(l_extendedprice, l_tax) AS e, corr(l_discount, l_tax) AS f FROM lineitem)
SELECT x, y, round(r + 1e-9, 6) AS r, abs(r) > 0.9 AS redundant FROM (SELECT 'l_quantity' AS x, 'l_extendedprice' AS y, a AS r FROM m UNION ALL SELECT 'l_quantity', 'l_discount', b FROM m UNION ALL SELECT 'l_quantity', 'l_tax', c FROM m UNION ALL SELECT 'l_extendedprice', 'l_discount', d FROM m UNION ALL SELECT 'l_extendedprice', 'l_tax', e FROM m UNION ALL SELECT 'l_discount', 'l_tax', f FROM m)""")
def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of columns correlated in one pass; strong pairs are marked."""
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    m = table(spark, sf_dir, "lineitem").agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return m.select(F.explode(rows).alias("s")).select("s.x", "s.y", fixed("s.r").alias("r"), (F.abs("s.r") > 0.9).alias("redundant"))


@query(f"WITH {_E}" + """, b AS (SELECT position, game % 3 AS lane, season, avg(abs(projected - actual)) AS ml, avg(abs(rival - actual)) AS heuristic FROM e GROUP BY ALL) SELECT position, round(avg(ml) + 1e-9, 6) AS ml, round(avg(heuristic) + 1e-9, 6) AS heuristic, CASE WHEN avg(ml) < avg(heuristic) THEN 'SHIP' ELSE 'SKIP' END AS verdict FROM b GROUP BY position""")
def ship_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a model beats the rule over all seasons, by position; ML and rule errors of equal folds."""
    err = lambda c: F.avg(F.abs(F.col(c) - F.col("actual")))
    b = errors(spark, sf_dir).groupBy("position", (F.col("game") % 3).alias("lane"), "season").agg(err("projected").alias("ml"), err("rival").alias("heuristic"))
    verdict = F.when(F.avg("ml") < F.avg("heuristic"), "SHIP").otherwise("SKIP")
    return b.groupBy("position").agg(fixed(F.avg("ml")).alias("ml"), fixed(F.avg("heuristic")).alias("heuristic"), verdict.alias("verdict"))

"""The driver's tables in the roles that the queries give them, in Spark and as SQL, and the register.

plays: lineitem as plays of a team in a week; games: orders as games between two teams.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelag.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

PLAYS = """plays AS (SELECT l_suppkey AS team, l_partkey % 100 AS opp, l_partkey AS player, l_orderkey AS game, CAST(l_linenumber AS BIGINT) AS play_no,
  CAST(year(l_shipdate) AS BIGINT) AS season, CAST(month(l_shipdate) AS BIGINT) AS week, l_discount - 0.05 AS epa, l_quantity AS yards, l_extendedprice AS value,
  CASE l_returnflag WHEN 'R' THEN 'pass' WHEN 'A' THEN 'run' ELSE 'other' END AS kind, CAST(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS BIGINT) AS success FROM lineitem)"""
GAMES = """games AS (SELECT o_orderkey AS game, o_custkey % 32 AS home, (o_custkey + 1 + o_orderkey % 31) % 32 AS away, CAST(year(o_orderdate) AS BIGINT) AS season, CAST(month(o_orderdate) AS BIGINT) AS week,
  CAST(o_orderdate AS DATE) AS day, CAST(o_orderkey * 7 % 45 AS BIGINT) AS home_score, CAST(o_orderkey * 11 % 43 AS BIGINT) AS away_score,
  CAST(o_custkey % 29 - 14 AS DOUBLE) / 2 AS spread, CAST(70 + o_custkey % 41 AS DOUBLE) / 2 AS total, o_orderkey % 17 AS referee, o_totalprice AS value FROM orders)"""


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "R", "pass").when(F.col("l_returnflag") == "A", "run").otherwise("other")
    return l.select(
        F.col("l_suppkey").alias("team"), (F.col("l_partkey") % 100).alias("opp"), F.col("l_partkey").alias("player"),
        F.col("l_orderkey").alias("game"), F.col("l_linenumber").cast("long").alias("play_no"),
        F.year("l_shipdate").cast("long").alias("season"), F.month("l_shipdate").cast("long").alias("week"),
        (F.col("l_discount") - 0.05).alias("epa"), F.col("l_quantity").alias("yards"), F.col("l_extendedprice").alias("value"),
        kind.alias("kind"), F.when(F.col("l_linestatus") == "O", 1).otherwise(0).cast("long").alias("success"),
    )


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k, c = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        k.alias("game"), (c % 32).alias("home"), ((c + 1 + k % 31) % 32).alias("away"),
        F.year("o_orderdate").cast("long").alias("season"), F.month("o_orderdate").cast("long").alias("week"), F.to_date("o_orderdate").alias("day"),
        (k * 7 % 45).alias("home_score"), (k * 11 % 43).alias("away_score"),
        ((c % 29 - 14).cast("double") / 2).alias("spread"), ((c % 41 + 70).cast("double") / 2).alias("total"), (k % 17).alias("referee"), F.col("o_totalprice").alias("value"),
    )


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name; {plays} and {games} in sql stand for the views above."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql.replace("{plays}", PLAYS).replace("{games}", GAMES)
        return f

    return register

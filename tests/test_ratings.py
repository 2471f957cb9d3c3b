"""Ratings of more suppliers than there are ranks in the scale, against the query's SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tidelag.plans import registry


@pytest.mark.parametrize("n", [40, 250])
def test_quartile_rating(spark, tmp_path, n):
    spark.range(n).select(F.col("id").alias("s_suppkey"), (F.col("id") % 5).cast("int").alias("s_nationkey"), (F.col("id") * 37 % 101 / 4 - 3).alias("s_acctbal")).write.parquet(str(tmp_path / "supplier.parquet"))
    spark.range(5).select(F.col("id").cast("int").alias("n_nationkey"), (F.col("id") % 2).cast("int").alias("n_regionkey")).write.parquet(str(tmp_path / "nation.parquet"))
    con = duckdb.connect()
    for t in ("supplier", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    found = registry.QUERIES["quartile_rating"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(found.columns)} FROM ({registry.ORACLES['quartile_rating']})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(want)

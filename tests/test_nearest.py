"""Nearest profiles and vectors where many are equal or tie, against the queries' SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tidelag.plans import players, registry


def against_sql(spark, folder, name, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    found = registry.QUERIES[name](spark, str(folder))
    want = con.execute(f"SELECT {', '.join(found.columns)} FROM ({registry.ORACLES[name]})").fetchall()
    key = lambda r: r[:2]
    got = sorted(map(tuple, found.collect()), key=key)
    assert want and got == [tuple(pytest.approx(v, abs=1e-9) if isinstance(v, float) else v for v in r) for r in sorted(want, key=key)]


@pytest.mark.parametrize("prices", [2, 40])
def test_knn_profile_of_equal_profiles(spark, tmp_path, prices):
    k = F.col("id")
    spark.range(1500).select(k.alias("p_partkey"), F.concat(F.lit("B"), (k % 2).cast("string")).alias("p_brand"), (k % 3).cast("int").alias("p_size"), (k * 7 % prices + 900.0).alias("p_retailprice")).write.parquet(str(tmp_path / "part.parquet"))
    against_sql(spark, tmp_path, "knn_profile", "part")


@pytest.mark.parametrize("tile", [7, 10_000])
def test_knn_cosine_in_tiles(spark, tmp_path, monkeypatch, tile):
    monkeypatch.setattr(players, "VECTOR_TILE", tile)
    k = F.col("id")
    v = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: ((k % 40) * i * 7 % 11 - 4.5).cast("float"))
    spark.range(160).select(k.alias("vec_id"), v.alias("embedding"), (k % 3).cast("int").alias("label")).write.parquet(str(tmp_path / "embeddings.parquet"))
    against_sql(spark, tmp_path, "knn_cosine", "embeddings")

"""Writing: partitioned Parquet, keyed upserts, edge tables, JSON reports."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, in local mode a temporary one where that is unset.

    Raises RuntimeError on a cluster that names none.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tidelag-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again, for tables that are read many times."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def latest_rows(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """One row per key, the first by order; give order a full tie-breaker."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__place", place).where("__place = 1").drop("__place")


def upserted(stored: DataFrame, changes: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """stored with changes applied: for each key the row of the highest version, changes before stored rows.

    Missing columns on either side are null. One shuffle by key.
    """
    both = stored.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return latest_rows(both, keys, [F.col(version).desc_nulls_last(), F.desc("__new")]).drop("__new")


def merged_edges(edges: DataFrame, keys: Sequence[str] = ("src", "dst", "season", "week")) -> DataFrame:
    """Edges once per key with the sum of `weight` and their number; null ends give no edge."""
    known = edges.where(F.col(keys[0]).isNotNull() & F.col(keys[1]).isNotNull())
    return known.groupBy(*keys).agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))


def write_partitions(df: DataFrame, path: str, keys: Sequence[str] = ("season", "week"), mode: str = "append") -> None:
    """Parquet in a folder per key; rows of one key meet in few files, and a hot key is split by size."""
    df.hint("rebalance", *keys).write.mode(mode).partitionBy(*keys).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small report, such as one row per check, as JSON lines."""
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, order: Sequence) -> None:
    """A report as CSV with a header, rows in order across its files; nulls are empty, texts are quoted where they must be."""
    df.orderBy(*order).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def with_audit(df: DataFrame, source: str) -> DataFrame:
    """df with audit columns: where it came from and when."""
    return df.withColumn("_source", F.lit(source)).withColumn("_loaded_at", F.current_timestamp())

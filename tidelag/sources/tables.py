"""Reading: tables of a folder, newest files of partitions, CSV and JSON with a schema, season checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df, or ValueError naming the columns that it lacks."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def newest_files(spark: SparkSession, path: str, keys: Sequence[str] = ("season", "week"), by_name: bool = True, schema: StructType | None = None) -> DataFrame:
    """The rows of the newest Parquet file of each partition under path.

    Newest is the largest file name (names end in a timestamp), or the latest change for by_name=False.
    Only one row per file is shuffled to find it; keys that no partition has are ignored.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.parquet(path)
    keys = [k for k in keys if k in df.columns]
    newest = F.col("_metadata.file_name") if by_name else F.col("_metadata.file_modification_time")
    files = df.select(*keys, F.col("_metadata.file_path").alias("__file"), newest.alias("__when")).distinct()
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__when"), F.desc("__file")))
    chosen = files.withColumn("__place", place).where("__place = 1").select("__file")
    return df.withColumn("__file", F.col("_metadata.file_path")).join(chosen, "__file", "left_semi").drop("__file")


def seasons(df: DataFrame, first: int, last: int, column: str = "season") -> DataFrame:
    """Rows of a range of seasons; on a partition column this prunes folders."""
    if first > last:
        raise ValueError(f"seasons {first} to {last} are none")
    return df.where(F.col(column).between(first, last))


def latest_season(df: DataFrame, wanted: int, column: str = "season") -> DataFrame:
    """Rows of the latest season up to `wanted`; none where all are later."""
    latest = df.where(F.col(column) <= wanted).agg(F.max(column).alias("__latest"))
    return df.join(F.broadcast(latest), F.col(column) == F.col("__latest")).drop("__latest")  # one row


def csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with a header under a given schema; quotes inside quotes are doubled; values that do not fit it are null."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


def envelopes(spark: SparkSession, path: str, records: str, schema: StructType | str) -> DataFrame:
    """One row per element of the array field `records` of JSON envelopes, beside the envelopes' other fields."""
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    return df.select(*[c for c in df.columns if c != records], F.explode(records).alias("__r")).select("*", "__r.*").drop("__r")

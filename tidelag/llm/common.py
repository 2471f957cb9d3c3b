"""What the text operators share: word patterns, staging tables and table reading."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: str.translate table: lower-case A to Z and leave every other letter alone.
LOWER_AZ = str.maketrans(UPPER, LOWER)
#: str.translate table for the same with all six gap characters made spaces, so split(" ") finds words.
FOLD = LOWER_AZ | {c: " " for c in range(9, 14)}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table under sf_dir."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words_of(text: Column) -> Column:
    """Array of the words of text; empty for null, empty or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def lower_az(text: Column) -> Column:
    """Lower-case A to Z only, as SQL's translate() does; other letters stay."""
    return F.translate(text, UPPER, LOWER)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever its letters' case: __name, with more underscores if need be."""
    taken, found = {c.lower() for c in df.columns}, f"__{name}"
    while found.lower() in taken:
        found = f"_{found}"
    return found


def where_made(df: DataFrame, condition: Column) -> DataFrame:
    """df.where(condition) on columns as they are made.

    The optimizer would else copy what the columns are made of into the filter, and work it out again for
    every use. A row number, which it does not move, holds the filter above the projection.
    """
    row = unused(df, "row")
    return df.withColumn(row, F.monotonically_increasing_id()).where(condition & (F.col(row) >= 0)).drop(row)


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir; in local mode one of our own where it is unset.

    Raises RuntimeError on a cluster that names none, whose executors would not see the driver's own disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tidelag-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidelag/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def drop_staged(df: DataFrame) -> None:
    """Delete a table that stage() wrote, once nothing reads it any more."""
    spark, path = df.sparkSession, df._staged_path
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)

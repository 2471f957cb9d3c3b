"""Whether the partitions of a folder are there, fresh and of a sensible size, from a listing of its files."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: bytes below which a file is taken for empty or broken.
LEAST_BYTES = 1_024


def files(spark: SparkSession, path: str, ending: str = ".parquet") -> DataFrame:
    """path, changed, bytes of every file below path whose name has the ending; contents are not read.

    Folders named key=value are left as parts of the path.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{ending}").load(path)
    return found.select("path", F.col("modificationTime").alias("changed"), F.col("length").alias("bytes"))


def partition_health(listed: DataFrame, expected: DataFrame, keys: Sequence[str], now: datetime.datetime, max_age: datetime.timedelta, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """A row for each expected partition, and for each other one that has files: keys, files, bytes, small_files, newest, level, problem.

    ERROR: missing (no file) or small (a file below least_bytes); WARN: stale (the newest file changed before now -
    max_age) or unexpected; else OK. The worst problem is told. Keys are read from the paths' key=value parts; expected
    has them as columns, null for a part that the path lacks. One row a file is aggregated, then joined.
    """
    named = [F.nullif(F.regexp_extract("path", f"/{k}=([^/]+)/", 1), F.lit("")).alias(k) for k in keys]
    per = listed.select(*named, "changed", "bytes").groupBy(*keys).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.count_if(F.col("bytes") < least_bytes).alias("small_files"), F.max("changed").alias("newest"))
    want = expected.select(*[F.col(k).cast("string").alias(f"__{k}") for k in keys]).distinct().withColumn("__wanted", F.lit(True))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    both = per.withColumn("__there", F.lit(True)).join(want, on, "full")
    oldest = F.lit(now - max_age).cast("timestamp")
    problem = F.when(F.col("__there").isNull(), "missing").when(F.col("small_files") > 0, "small").when(F.col("newest") < oldest, "stale").when(F.col("__wanted").isNull(), "unexpected")
    level = F.when(problem.isin("missing", "small"), "ERROR").when(problem.isNotNull(), "WARN").otherwise("OK")
    key = [F.when(F.col("__there").isNull(), F.col(f"__{k}")).otherwise(F.col(k)).alias(k) for k in keys]
    return both.select(*key, F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("small_files", F.lit(0)).alias("small_files"), "newest", level.alias("level"), problem.alias("problem"))

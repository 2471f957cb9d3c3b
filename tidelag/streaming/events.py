"""Structured Streaming versions of the snapshot and event operators.

Every function takes and gives a streaming DataFrame with an event time of type timestamp; run() ends a
query when its input is used up, with its state in the checkpoint folder that is given.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read(spark: SparkSession, path: str, schema: StructType, time: str = "ts", files_per_batch: int = 8) -> DataFrame:
    """A stream of the Parquet files of a folder, or of one file; the time column is made a timestamp."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    alone = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()
    folder, names = (path.rpartition("/")[0], path.rpartition("/")[2]) if alone else (path, "*.parquet")
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", names).parquet(folder)
    return s.withColumn(time, F.col(time).cast("timestamp"))


def tumbling(events: DataFrame, keys: list[str], time: str = "ts", width: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Count and mean of `value` per window, sliding if slide is given; rows later than `late` drop out."""
    w = F.window(time, width, slide)
    return events.withWatermark(time, late).groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(*keys, F.col("w.start").alias("start"), "n", "mean")


def sessions(events: DataFrame, key: str, time: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions that end after a gap."""
    w = F.session_window(time, gap)
    return events.withWatermark(time, late).groupBy(key, w.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(events: DataFrame, keys: list[str], time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each key once while it is within the watermark: the idempotent poll."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def open_close(events: DataFrame, key: str, time: str = "ts", day: str = "1 day", late: str = "1 hour") -> DataFrame:
    """First and last value of each key and day."""
    g = events.withWatermark(time, late).groupBy(key, F.window(time, day).alias("w"))
    return g.agg(F.min_by("value", time).alias("opened"), F.max_by("value", time).alias("closed")).select(key, F.col("w.start").alias("start"), "opened", "closed")


def with_closing(events: DataFrame, folder: str) -> DataFrame:
    """events and the rows of a folder, which must be there, that close_all() writes to."""
    closing = events.sparkSession.readStream.schema(events.schema).parquet(folder)
    return events.unionByName(closing)


def close_all(events: DataFrame, folder: str, after: datetime.datetime, time: str = "ts") -> None:
    """Write one row of nulls at the time `after`, beyond every window, gap and lateness.

    Run the stream again after it from the same checkpoint: the watermark passes all that is open, which
    is given out, and the row's own window stays open.
    """
    row = {time: after}
    events.sparkSession.createDataFrame([tuple(row.get(c) for c in events.columns)], events.schema).write.mode("append").parquet(folder)


def run(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write all that is there as Parquet, exactly once, and end."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

"""Streaming queries, run to the end of the events table, and a batch window with its oracle."""

from __future__ import annotations

import datetime
import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelag.functions.scalars import fixed
from tidelag.plans.inputs import query
from tidelag.sources.sinks import shared_folder
from tidelag.sources.tables import table
from tidelag.streaming import events as E
from tidelag.streaming import polls


def _streamed(spark: SparkSession, sf_dir: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    batch = table(spark, sf_dir, "events")
    here = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    out = build(E.read(spark, f"{sf_dir}/events.parquet", batch.schema))
    E.run(out, f"{here}/out", f"{here}/state")
    return spark.read.schema(out.schema).parquet(f"{here}/out")


def _closed(spark: SparkSession, sf_dir: str, build: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """build(events, late) over all events: late covers the whole table, so that the order of its files does
    not matter, and the stream is closed at the end, so that nothing stays open."""
    batch = table(spark, sf_dir, "events")
    first, last = batch.agg(F.min(F.col("ts").cast("timestamp")).cast("double"), F.max(F.col("ts").cast("timestamp")).cast("double")).first()
    first, last = (math.floor(first), math.ceil(last)) if first is not None else (0, 0)
    late, here = last - first + 1, f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    events = E.read(spark, f"{sf_dir}/events.parquet", batch.schema)
    spark.createDataFrame([], events.schema).write.parquet(f"{here}/closing")
    out = build(E.with_closing(events, f"{here}/closing"), f"{late} seconds")
    E.run(out, f"{here}/out", f"{here}/state")
    E.close_all(events, f"{here}/closing", datetime.datetime.fromtimestamp(last + late + 2 * 86400, datetime.UTC))
    E.run(out, f"{here}/out", f"{here}/state")
    return spark.read.schema(out.schema).parquet(f"{here}/out")


def _plain(df: DataFrame, *numbers: str) -> DataFrame:
    """Times without a zone, as the tables have them, and rounded numbers."""
    times = [c for c, t in df.dtypes if t == "timestamp"]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in times} | {c: fixed(c) for c in numbers})


@query("""SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, CAST(count(*) AS BIGINT) AS n, round(avg(value) + 1e-9, 6) AS mean FROM events WHERE ts IS NOT NULL GROUP BY ALL""")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts per kind, the last hour's too."""
    return _plain(_closed(spark, sf_dir, lambda e, late: E.tumbling(e, ["event_type"], late=late)), "mean")


@query("""WITH w AS (SELECT event_type, value, time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE * unnest([0, 1]) AS start FROM events WHERE ts IS NOT NULL)
SELECT event_type, start, CAST(count(*) AS BIGINT) AS n, round(avg(value) + 1e-9, 6) AS mean FROM w GROUP BY ALL""")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours that begin every 30 minutes, so each event is in two."""
    return _plain(_closed(spark, sf_dir, lambda e, late: E.tumbling(e, ["event_type"], late=late, slide="30 minutes")), "mean")


@query("""WITH g AS (SELECT user_id, ts, CAST(ts - lag(ts) OVER w <= INTERVAL 30 MINUTE AS INTEGER) AS joined FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(1 - coalesce(joined, 0)) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of every user that end after a gap of 30 minutes, or with the table."""
    return _plain(_closed(spark, sf_dir, lambda e, late: E.sessions(e, "user_id", late=late)))


@query("""SELECT user_id, date_trunc('day', ts) AS start, arg_min(value, ts) AS opened, arg_max(value, ts) AS closed FROM events WHERE ts IS NOT NULL GROUP BY ALL""")
def stream_open_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last value of every user's days."""
    return _plain(_closed(spark, sf_dir, lambda e, late: E.open_close(e, "user_id", late=late)))


@query("""SELECT event_id, ts, user_id, event_type, value, props FROM events QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts) = 1""")
def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event once, however often it is polled."""
    return _plain(_streamed(spark, sf_dir, lambda e: E.first_seen(e, ["event_id"])))


@query("""SELECT user_id, event_type, event_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC NULLS LAST, event_id DESC) = 1""")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event of every user and kind, merged batch by batch into a keyed table."""
    here = f"{shared_folder(spark)}/polls/{uuid.uuid4().hex}"
    version = F.struct("ts", "event_id").alias("version")
    rows = E.read(spark, f"{sf_dir}/events.parquet", table(spark, sf_dir, "events").schema).select("user_id", "event_type", "value", version)
    polls.poll(rows, f"{here}/table", f"{here}/state", ["user_id", "event_type"], "version")
    return _plain(polls.current(spark, f"{here}/table", rows.schema).select("user_id", "event_type", "version.event_id", "version.ts", "value"))


@query("""SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, CAST(count(*) AS BIGINT) AS n, round(avg(value) + 1e-9, 6) AS mean FROM events GROUP BY ALL""")
def window_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same windows over the finished table."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("start")).agg(F.count("*").alias("n"), fixed(F.avg("value")).alias("mean"))

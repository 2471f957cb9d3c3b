"""A session with the settings that the library counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(name: str = "tidelag", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew joins, Arrow transfer. conf keys have _ for each dot.

    shuffle_partitions is the count that adaptive execution starts from and merges downwards; leave it
    unset on a cluster that configures it.
    """
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings |= {k.replace("_", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()

"""A stateful poll: a stream merged into a keyed table, newest version of each key, with a ledger of its batches.

The table is dealt into buckets by a hash of the key. A batch rewrites only the buckets that it touches, under
its own number, and then enters them in the ledger; readers take each bucket as of its last entry. So a batch
that broke off is never seen, one that is played again replaces what it wrote, and rows that come late never
replace newer ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidelag.sources.sinks import upserted

#: Most buckets of a table, and so the most ledger rows that a batch reads to the driver.
BUCKETS = 64
LEDGER = "batch long, bucket int, n_rows long"


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """One row per batch and bucket that it wrote; none before the first batch."""
    try:
        return spark.read.schema(LEDGER).parquet(f"{path}/ledger")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def current(spark: SparkSession, path: str, schema: StructType, before: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
    """The table's rows, of some buckets if given, as of the batches before a number if given.

    Only the folders of the last versions are listed and read.
    """
    entries = ledger(spark, path)
    if before is not None:
        entries = entries.where(F.col("batch") < before)
    if buckets is not None:
        entries = entries.where(F.col("bucket").isin(*buckets))
    last = entries.groupBy("bucket").agg(F.max("batch").alias("batch")).collect()  # at most BUCKETS rows
    if not last:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/data/batch={r.batch}/bucket={r.bucket}" for r in last])


def merge_batch(batch: DataFrame, number: int, path: str, keys: Sequence[str], version: str, buckets: int = BUCKETS) -> None:
    """Merge one batch; the same number again gives the same table.

    A null version is older than any other. Rows of a batch with equal keys and versions must be equal.
    """
    spark, schema = batch.sparkSession, batch.schema
    dealt = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    touched = [r.bucket for r in dealt.select("bucket").distinct().collect()]  # at most `buckets` rows
    if not touched:
        return
    merged = upserted(current(spark, path, schema, number, touched), batch, keys, version)
    target = f"{path}/data/batch={number}"
    merged.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
    written = spark.read.parquet(target).groupBy("bucket").agg(F.count("*").alias("n_rows"))
    written.select(F.col("bucket").cast("int").alias("bucket"), "n_rows").coalesce(1).write.mode("overwrite").parquet(f"{path}/ledger/batch={number}")


def poll(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], version: str, buckets: int = BUCKETS) -> None:
    """Merge all that is there and end; the next call goes on where this one ended."""
    if not 0 < buckets <= BUCKETS:
        raise ValueError(f"1 to {BUCKETS} buckets, not {buckets}")

    def step(batch: DataFrame, number: int) -> None:
        batch.persist()  # read for its buckets and for the merge
        try:
            merge_batch(batch, number, path, keys, version, buckets)
        finally:
            batch.unpersist()

    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(step).start().awaitTermination()

"""The keyed table that a stream is merged into: late rows, replays, broken batches."""

import time

import pytest

from tidelag.streaming import polls

SCHEMA = "k long, ts long, v string"


def newest(rows):
    best = {}
    for k, ts, v in rows:
        if k not in best or (ts is not None and (best[k][0] is None or ts > best[k][0])):
            best[k] = (ts, v)
    return best


def held(spark, path, schema):
    found = [tuple(r) for r in polls.current(spark, path, schema).collect()]
    assert len({k for k, *_ in found}) == len(found)
    return {k: tuple(v) for k, *v in found}


def test_batches_late_rows_and_restarts(spark, tmp_path):
    path, source, state = str(tmp_path / "table"), tmp_path / "in", str(tmp_path / "state")
    schema = spark.createDataFrame([], SCHEMA).schema
    assert held(spark, path, schema) == {}
    batches = [[(k, 10, "first") for k in range(50)], [(k, 20 if k % 2 else 5, f"second {k}") for k in range(30, 70)], [(1, None, "no version"), (200, None, "alone"), (None, 3, "null key")]]
    seen = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        time.sleep(0.01)
        seen += rows
        stream = spark.readStream.schema(schema).parquet(str(source))
        polls.poll(stream, path, state, ["k"], "ts", buckets=8)
        assert held(spark, path, schema) == newest(seen)
    before = polls.ledger(spark, path).count()
    polls.poll(spark.readStream.schema(schema).parquet(str(source)), path, state, ["k"], "ts", buckets=8)
    assert polls.ledger(spark, path).count() == before  # nothing new, nothing written
    assert held(spark, path, schema) == newest(seen)


def test_replay_and_a_batch_that_broke_off(spark, tmp_path):
    path = str(tmp_path / "table")
    a, b = spark.createDataFrame([(k, 1, "a") for k in range(20)], SCHEMA), spark.createDataFrame([(k, 2, "b") for k in range(10, 30)], SCHEMA)
    polls.merge_batch(a, 0, path, ["k"], "ts", 4)
    a.withColumnRenamed("v", "w").selectExpr("k", "ts", "'broken' AS v", "0 AS bucket").write.partitionBy("bucket").parquet(f"{path}/data/batch=1")  # no entry in the ledger
    assert {v for _, v in held(spark, path, a.schema).values()} == {"a"}
    for _ in range(2):
        polls.merge_batch(b, 1, path, ["k"], "ts", 4)
        assert held(spark, path, a.schema) == {k: (2, "b") if k >= 10 else (1, "a") for k in range(30)}
    polls.merge_batch(a.limit(0), 2, path, ["k"], "ts", 4)
    assert len(held(spark, path, a.schema)) == 30
    assert polls.ledger(spark, path).where("batch = 1").agg({"n_rows": "sum"}).first()[0] >= 20


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "table")
    polls.merge_batch(spark.range(1000).selectExpr("id AS k", "1L AS ts", "'a' AS v"), 0, path, ["k"], "ts", 16)
    polls.merge_batch(spark.createDataFrame([(5, 2, "b")], SCHEMA), 1, path, ["k"], "ts", 16)
    assert polls.ledger(spark, path).where("batch = 1").count() == 1 and polls.ledger(spark, path).where("batch = 0").count() == 16
    assert len(held(spark, path, spark.createDataFrame([], SCHEMA).schema)) == 1000


def test_bucket_limit(spark, tmp_path):
    with pytest.raises(ValueError, match="buckets"):
        polls.poll(spark.readStream.format("rate").load(), str(tmp_path / "t"), str(tmp_path / "s"), ["value"], "timestamp", buckets=1000)

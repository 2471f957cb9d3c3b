"""Readers, reports and the health of partitions on folders of a few files."""

import datetime
import json
import os

from pyspark.sql import functions as F

from tidelag.sources import health, sinks, tables

NOW = datetime.datetime(2024, 9, 10, 12, 0, tzinfo=datetime.timezone.utc)


def put(path, size, age_days):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"x" * size)
    t = (NOW - datetime.timedelta(days=age_days)).timestamp()
    os.utime(path, (t, t))


def test_missing_stale_small_and_unexpected_partitions(spark, tmp_path):
    put(tmp_path / "season=2024/week=1/a.parquet", 5000, 1)
    put(tmp_path / "season=2024/week=1/b.parquet", 4000, 9)
    put(tmp_path / "season=2024/week=2/a.parquet", 5000, 8)
    put(tmp_path / "season=2024/week=3/a.parquet", 100, 0)
    put(tmp_path / "season=2024/week=4/a.csv", 5000, 0)
    put(tmp_path / "season=2023/week=18/a.parquet", 5000, 0)
    listed = health.files(spark, str(tmp_path))
    assert listed.count() == 5 and listed.columns == ["path", "changed", "bytes"]
    expected = spark.createDataFrame([(2024, w) for w in (1, 2, 3, 4)] + [(2024, 1)], "season int, week int")
    got = {(r["season"], r["week"]): r for r in health.partition_health(listed, expected, ("season", "week"), NOW, datetime.timedelta(days=7)).collect()}
    assert {k: (r["level"], r["problem"], r["files"]) for k, r in got.items()} == {
        ("2024", "1"): ("OK", None, 2), ("2024", "2"): ("WARN", "stale", 1), ("2024", "3"): ("ERROR", "small", 1), ("2024", "4"): ("ERROR", "missing", 0), ("2023", "18"): ("WARN", "unexpected", 1),
    }
    assert got["2024", "1"]["bytes"] == 9000 and got["2024", "4"]["newest"] is None
    none = health.partition_health(listed.limit(0), expected.limit(0), ("season", "week"), NOW, datetime.timedelta(days=7))
    assert none.count() == 0


def test_csv_reads_by_schema_and_reports_are_written_in_order(spark, tmp_path):
    d = spark.createDataFrame([(2, 'say "no", twice', 1.5), (1, None, None), (3, "é", 2.0)], "id int, name string, x double")
    sinks.write_csv(d, f"{tmp_path}/report", ["id"])
    back = tables.csv(spark, f"{tmp_path}/report", "id int, name string, x double")
    assert sorted(map(tuple, back.collect())) == [(1, None, None), (2, 'say "no", twice', 1.5), (3, "é", 2.0)]
    (tmp_path / "bad.csv").write_text("id,name,x\n1,a,2.5\nnot a number,b,3\n")
    assert sorted(map(tuple, tables.csv(spark, f"{tmp_path}/bad.csv", "id int, name string, x double").collect()), key=repr) == [(1, "a", 2.5), (None, "b", 3.0)]


def test_envelopes_reports_audit_and_newest_by_change(spark, tmp_path):
    (tmp_path / "box.json").write_text(json.dumps({"fetched": "2024-09-01", "players": [{"id": 1, "rank": 5}, {"id": 2}]}, indent=1))
    got = tables.envelopes(spark, f"{tmp_path}/box.json", "players", "fetched string, players array<struct<id: int, rank: int>>")
    assert sorted(map(tuple, got.collect())) == [("2024-09-01", 1, 5), ("2024-09-01", 2, None)]
    sinks.write_report(got, f"{tmp_path}/report")
    sinks.write_report(got.limit(1), f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report").count() == 1
    r = sinks.with_audit(got, "box").first()
    assert r["_source"] == "box" and r["_loaded_at"] is not None
    for name, value, age in (("z_20240101.parquet", 1, 5), ("a_20240901.parquet", 2, 1)):
        folder = tmp_path / "in/season=2024"
        spark.range(1).select(F.lit(value).alias("v")).coalesce(1).write.parquet(f"{tmp_path}/made{value}")
        folder.mkdir(parents=True, exist_ok=True)
        made = next((tmp_path / f"made{value}").glob("part-*.parquet"))
        made.rename(folder / name)
        t = (NOW - datetime.timedelta(days=age)).timestamp()
        os.utime(folder / name, (t, t))
    newest = lambda by_name: [x["v"] for x in tables.newest_files(spark, f"{tmp_path}/in", by_name=by_name).collect()]
    assert newest(False) == [2] and newest(True) == [1]

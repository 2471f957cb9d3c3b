"""Windows, scalars, joins, sources and sinks on small frames with known answers."""

import datetime
import os
import random
from collections import Counter

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidelag.functions import scalars as S
from tidelag.functions import windows as W
from tidelag.operators.joins import as_of, departures_arrivals, fallback, fuzzy_by_token, prior_range
from tidelag.plans import models, streams
from tidelag.sources.sinks import merged_edges, upserted, write_partitions
from tidelag.sources.tables import latest_season, newest_files, require, seasons


def values(df, order, col):
    return [r[col] for r in df.orderBy(*order).collect()]


def test_lagged_mean_never_sees_its_own_row(spark):
    df = spark.createDataFrame([("A", 1, 0.075), ("A", 2, 0.2), ("A", 4, None), ("A", 5, 1.0), ("B", 1, 3.0)], "team string, week int, x double")
    w = W.by(("team",), ("week",))
    got = df.select("team", "week", W.lagged_mean("x", w, 3).alias("m"), W.lagged_mean("x", w, 3, 2).alias("m2"), W.calendar_sum("x", w, 2).alias("c"))
    assert values(got, ("team", "week"), "m") == [None, 0.075, pytest.approx(0.1375), pytest.approx(0.1375), None]
    assert values(got, ("team", "week"), "m2") == [None, None, pytest.approx(0.1375), pytest.approx(0.1375), None]
    assert values(got, ("team", "week"), "c") == [None, 0.075, 0.2, None, None]


def test_ewm_and_slope_against_pandas(spark):
    x = [1.0, None, 4.0, 2.0, None, 7.0, 3.0]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(x)], "k int, i int, x double")
    w = W.by(("k",), ("i",))
    got = df.select("i", W.lagged_ewm("x", w, 3.0).alias("e"), W.lagged_slope("x", w, 4).alias("s"))
    want = pd.Series(x).shift(1).ewm(halflife=3).mean()
    assert values(got, ("i",), "e")[1:] == pytest.approx(want.tolist()[1:])
    slopes = values(got, ("i",), "s")
    assert slopes[:4] == [None] * 4 and slopes[4] == pytest.approx(0.5)


def test_streak_product_envelope_and_ranks(spark):
    df = spark.createDataFrame([(1, i, s, p, c) for i, (s, p, c) in enumerate([(1, 0.5, 9.0), (1, 0.5, 9.2), (-1, 0.0, 5.0), (-1, 0.9, 4.9), (1, 0.5, 1.0)])], "k int, i int, s int, p double, c double")
    w = W.by(("k",), ("i",))
    got = W.signed_streak(df, "s", ["k"], ["i"], "streak")
    assert values(got, ("i",), "streak") == [0, 1, 2, -1, -2]
    got = df.select("i", W.lagged_product("p", w).alias("r"), W.decreasing_envelope("c", "i", w, 0.5).alias("e"))
    assert values(got, ("i",), "r") == pytest.approx([1.0, 0.5, 0.25, 0.0, 0.0])
    assert values(got, ("i",), "e") == pytest.approx([9.0, 8.5, 5.0, 4.5, 1.0])


def test_scalars(spark):
    one = spark.range(1)
    got = one.select(
        S.american_probability(F.lit(150)).alias("a"), S.american_probability(F.lit(-110)).alias("b"), S.american_probability(F.lit(0)).alias("z"), S.normal_cdf(F.lit(1.0)).alias("c"), S.normal_quantile(F.lit(0.975)).alias("q"),
        S.haversine_miles(F.lit(40.0), F.lit(-74.0), F.lit(34.0), F.lit(-118.0)).alias("m"), S.inches(F.lit("5-11")).alias("h"), S.inches(F.lit("tall")).alias("h0"), S.minutes_seconds(F.lit("7:05")).alias("t"),
        S.normal_name(F.lit("D'Andre O-Neal Jr.")).alias("n"), S.token_jaccard(F.array(), F.array()).alias("j"), S.ratio(F.lit(1.0), F.lit(0.0)).alias("r"), S.decay(F.lit(24.0), 24, 72).alias("d"), S.clip(F.lit(None).cast("double"), 0, 1).alias("k"),
    ).first()
    assert got["a"] == pytest.approx(0.4) and got["b"] == pytest.approx(110 / 210) and got["z"] is None
    assert got["c"] == pytest.approx(0.841345, abs=1e-6) and got["q"] == pytest.approx(1.96, abs=1e-3) and 2400 < got["m"] < 2500
    assert (got["h"], got["h0"], got["t"], got["n"], got["j"], got["r"], got["d"], got["k"]) == (71, None, 425, "dandre o neal", 0.0, None, 0.5, None)


def test_joins(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9), (4, None, 9)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 1, 10), ("a", 4, 40), ("a", 5, 50), ("b", None, 7), (None, 2, 3)], "k string, u int, v int")
    got = as_of(left, right, ["k"], "t", "u", ["v"])
    assert values(got, ("id",), "v") == [40, None, None, 3]
    assert values(as_of(left, right, ["k"], "t", "u", ["v"], strict=False), ("id",), "v") == [50, 10, None, 3]
    use = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("a", 5, 9.0)], "k string, week int, y double")
    got = prior_range(spark.createDataFrame([("a", 3), ("a", 6), ("c", 1)], "k string, week int"), use, ["k"], "week", 2, [F.sum("y").alias("s")])
    assert values(got, ("k", "week"), "s") == [3.0, 9.0, None]
    by = spark.createDataFrame([(1, "x", 1.0), (1, "x", 2.0), (9, "y", 3.0)], "id int, name string, v double")
    got = fallback(spark.createDataFrame([(1, "q"), (5, "y"), (6, None)], "id int, name string"), by, "id", "name", ["v"])
    assert [(r["v"], r["matched_by"]) for r in got.orderBy("id").collect()] == [(1.0, "id"), (3.0, "name"), (None, "none")]
    b, a = (spark.createDataFrame(x, "p int, team string") for x in ([(1, "A"), (2, "A"), (3, "B")], [(1, "A"), (2, "B"), (4, "B")]))
    assert {tuple(r) for r in departures_arrivals(b, a, "p", "team").collect()} == {(2, "A", "B"), (3, "B", None), (4, None, "B")}
    names = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "b", "d"]), (3, ["x"]), (4, []), (5, None)], "id int, tokens array<string>")
    got = fuzzy_by_token(names, names, "tokens", 0.5).where("ida < idb").collect()
    assert [(r["ida"], r["idb"], r["similarity"]) for r in got] == [(1, 2, 0.5)]


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, 2020), (2, 1, 2021)], "id int, v int, season int")
    path = str(tmp_path / "t")
    write_partitions(df, path, ["season"])
    pd.DataFrame({"id": [7], "v": [9]}, dtype="int32").to_parquet(f"{path}/season=2021/zz_20991231.parquet")
    spark.catalog.refreshByPath(path)
    got = newest_files(spark, path, ["season"], schema=df.schema)
    assert {tuple(r) for r in got.select("id", "season").collect()} == {(1, 2020), (7, 2021)}
    assert seasons(df, 2021, 2022).count() == 1 and latest_season(df, 2020).first()["id"] == 1
    with pytest.raises(ValueError, match="nope"):
        require(df, ["id", "nope"])
    changes = spark.createDataFrame([(1, 5, 2020), (3, 3, 2020)], "id int, v int, season int")
    assert {(r["id"], r["v"]) for r in upserted(df, changes, ["id"], "season").collect()} == {(1, 5), (2, 1), (3, 3)}
    edges = spark.createDataFrame([(1, 2, 2020, 1, 1.0), (1, 2, 2020, 1, 2.0), (None, 2, 2020, 1, 5.0)], "src int, dst int, season int, week int, weight double")
    assert [(r["weight"], r["n"]) for r in merged_edges(edges).collect()] == [(3.0, 2)]


def test_streams_give_out_all_events_whatever_the_files_order(spark, tmp_path):
    base = datetime.datetime(2024, 1, 1)
    rows = [(i, base + datetime.timedelta(minutes=17 * i), i % 3, "ab"[i % 2], float(i)) for i in range(240)]
    folder = tmp_path / "events.parquet"
    folder.mkdir()
    for k in range(12):  # more files than a batch has, the newest events first
        pq.write_table(pa.table(dict(zip(("event_id", "ts", "user_id", "event_type", "value"), zip(*rows[20 * k : 20 * k + 20], strict=True), strict=True))), folder / f"{k}.parquet")
        os.utime(folder / f"{k}.parquet", (1_700_000_000 - 60 * k,) * 2)
    found = streams.stream_tumbling(spark, str(tmp_path)).collect()
    want = Counter((t, ts.replace(minute=0)) for _, ts, _, t, _ in rows)
    assert {(r["event_type"], r["start"].replace(tzinfo=None)): r["n"] for r in found} == want and len(found) == len(want)
    assert sorted((r["user_id"], r["n"]) for r in streams.stream_sessions(spark, str(tmp_path)).collect()) == sorted((u, 1) for _, _, u, _, _ in rows)


def test_walk_forward_predicts_every_season_but_the_first(spark):
    found = models.ridge_walk_forward(spark, "/root/testdata/sf0.001")
    assert {r["season"] for r in found.select("season").distinct().collect()} == set(range(1996, 2002))


def test_lines_ladders_and_key_numbers(spark):
    import math

    tail = lambda t, mean, cv: 0.5 * math.erfc((t - mean) / (cv * mean) / math.sqrt(2))
    poisson = lambda t, mean: 1 - sum(math.exp(-mean) * mean**i / math.factorial(i) for i in range(t))
    one = spark.range(1)
    mean = lambda p: one.select(S.implied_mean(F.lit(62.5), F.lit(p), 0.55)).first()[0]
    assert mean(0.5) == pytest.approx(62.5, abs=0.02) and mean(0.55) > 62.5 > mean(0.45)
    assert mean(0.999) == pytest.approx(62.5 / 0.45) and mean(None) is None
    for want in (640.0, 1010.0, 1800.0):
        got = one.select(S.ladder_mean((750, 1000, 1250), [F.lit(tail(t, want, 0.25)) for t in (750, 1000, 1250)], 0.25).alias("l")).first()["l"]
        assert got["mean"] == pytest.approx(want, abs=0.02) and got["err"] < 1e-9
    got = one.select(S.ladder_mean((6, 8, 10), [F.lit(poisson(t, 7.25)) for t in (6, 8, 10)]).alias("l")).first()["l"]
    assert got["mean"] == pytest.approx(7.25, abs=0.02)
    moves = spark.createDataFrame([(-2.5, -3.5), (3.0, 3.5), (-7.0, -6.5), (2.0, 2.5)], "a double, b double")
    assert [r[0] for r in moves.select(S.crosses(F.abs("a"), F.abs("b"), (3, 7, 10))).collect()] == [True, False, True, False]


def test_fuzzy_pairs_of_frequent_tokens_are_those_of_brute_force(spark):
    rng = random.Random(5)
    sets = [(i, rng.sample("abcdefghijklmnopqrstuvwxyz", rng.choice([1, 2, 3, 4, 5, 8, 14, 16, 17, 20, 22]))) for i in range(300)]
    sets += [(1000 + i, [t for t in s if rng.random() > 0.08] + ["zz"] * (i % 3 == 0)) for i, s in sets]
    df = spark.createDataFrame(sets, "id int, tokens array<string>")
    for least in (0.7, 0.8, 1.0):
        got = {(r["ida"], r["idb"]) for r in fuzzy_by_token(df, df, "tokens", least).collect()}
        assert got == {(i, j) for i, a in sets for j, b in sets if a and b and len({*a} & {*b}) >= least * len({*a} | {*b}) - 1e-12}

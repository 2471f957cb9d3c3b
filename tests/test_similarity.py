"""Nearest earlier profiles and the graph of likenesses against all pairs in plain Python."""

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidelag.functions.scalars import fixed
from tidelag.operators import similarity as S
from tidelag.plans import registry

SCHEMA = "id long, block string, season int, pick int, round int, wt double, forty double, vertical double, broad_jump double, school string, style string, extra string"


def rows(n=160, seed=7):
    r = random.Random(seed)
    some = lambda v, p=0.2: None if r.random() < p else v
    out = []
    for i in range(n):
        school = r.choice(["a", "b", "c", " ", None])
        out.append((i, r.choice("XY"), r.randint(2000, 2006), some(r.randint(1, 270), 0.05), some(r.randint(1, 7), 0.05), some(float(r.randint(140, 360))), some(r.uniform(4.1, 5.6)), some(float(r.randint(18, 48))), some(float(r.randint(85, 145))), school, {"a": "s", "b": "s"}.get(school), "x"))
    for i in range(n, n + 40):  # copies of one profile in several seasons
        out.append((i, "X", 2000 + i % 4, 10, 1, 200.0, 4.5, None, 120.0, "a", "s", "x"))
    return [*out, (None, "X", 2003, 1, 1, None, None, None, None, None, None, None), (900, None, 2003, 1, 1, None, None, None, None, None, None, None), (901, "Z", 2003, None, None, None, None, None, None, None, None, None), (902, "Z", None, None, None, None, None, None, None, None, None, None)]


def like(a, b):
    scale = lambda v, lo, hi: None if v is None else min(max((v - lo) / (hi - lo), 0), 1)
    middle = lambda v, lo, hi: 0.5 if v is None else scale(v, lo, hi)
    draft = 1 - (0.6 * abs(middle(a[3], 1, 260) - middle(b[3], 1, 260)) + 0.4 * abs(middle(a[4], 1, 7) - middle(b[4], 1, 7)))
    off = [abs(scale(a[i], *r) - scale(b[i], *r)) for i, r in zip(range(5, 9), [(150, 350), (4.2, 5.5), (20, 46), (90, 140)], strict=True) if a[i] is not None and b[i] is not None]
    x, y = (a[9] or "").strip(), (b[9] or "").strip()
    school = 1.0 if x and x == y else 0.7 if x and y and a[10] and a[10] == b[10] else 0.3
    return round(0.3 * draft + 0.5 * (1 - sum(off) / len(off) if off else 0.5) + 0.2 * school + 1e-9, 6)


@pytest.mark.parametrize("large", [0, S.LARGE_BLOCK])
def test_nearest_earlier_is_brute_force(spark, large):
    data = rows()
    got = {}
    for r in S.nearest_earlier(spark.createDataFrame(data, SCHEMA).repartition(5), large_block=large).collect():
        got.setdefault(r.id, []).append((-r.similarity, r.comp))
    want = {}
    for a in data:
        if a[0] is not None and a[1] is not None and a[2] is not None:
            found = sorted((-like(a, b), b[0]) for b in data if b[0] is not None and b[1] == a[1] and b[2] is not None and b[2] < a[2])[:5]
            if found:
                want[a[0]] = found
    assert {k: [(pytest.approx(s, abs=2e-6), c) for s, c in v] for k, v in want.items()} == {k: sorted(v) for k, v in got.items()}


@pytest.mark.parametrize(("least", "large"), [(0.97, 0), (0.97, 100), (0.7, 0), (0.3, 1000)])
def test_graph_is_brute_force(spark, least, large):
    data = [r for r in rows() if r[0] is not None and r[1] is not None]
    df = spark.createDataFrame(data, SCHEMA)
    edges = S.similarity_graph(df, least, large).collect()
    assert len({(e.a, e.b) for e in edges}) == len(edges)
    classes = {}
    for r in data:
        key = (r[1], *r[3:9], (r[9] or "").strip())
        key = tuple(min(max(v, lo), hi) if v is not None else None for v, lo, hi in zip(key[1:7], (1, 1, 150, 4.2, 20, 90), (260, 7, 350, 5.5, 46, 140), strict=True)) + (key[0], key[7])
        classes.setdefault(key, []).append(r)
    first = {v[0][0]: v for v in classes.values()}
    want = {(a, b): len(first[a]) * len(first[b]) for a in first for b in first if a < b and first[a][0][1] == first[b][0][1] and like(first[a][0], first[b][0]) >= least}
    assert {(e.a, e.b): e.a_size * e.b_size for e in edges} == want


def test_far_profiles_never_meet(spark):
    """Candidates of a small radius are few of all pairs: one in 14 for measures that fill their ranges evenly."""
    c = S.profile_classes(spark.range(4000).select("id", F.lit("X").alias("block"), F.lit(2000).alias("season"), (F.col("id") % 260 + 1).alias("pick"), (F.col("id") % 7 + 1).alias("round"), *[(lo + (hi - lo) * F.rand(i)).alias(m) for i, (m, (lo, hi)) in enumerate(S.MEASURES.items())], F.lit("a").alias("school"), F.lit(None).cast("string").alias("style")))
    c, masks = c.persist(), S.shared_masks(c, 0)
    spots = lambda around: (lambda d, on: d.groupBy(*on).count())(*S._spots(c, 0.03, masks, around))
    a, b = spots(True), spots(False).withColumnRenamed("count", "n")
    met = a.join(b, [x for x in a.columns if x != "count"]).agg(F.sum(F.col("count") * F.col("n"))).first()[0]
    assert met < 4000 * 4000 / 12


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert S.nearest_earlier(empty).count() == 0 and S.similarity_graph(empty, 0.9).count() == 0


def test_comparison_features(spark):
    comps = spark.createDataFrame([(1, 4.0, 8.0, 2), (1, 6.0, 10.0, 4), (1, None, None, 0), (2, None, None, 0)], "player_id long, comp_nfl_ppg double, comp_best_season_ppg double, comp_seasons_played long")
    assert [tuple(r) for r in S.comparison_features(comps).collect()] == [(1, 9.5, 8.5, 9.0, 0.5, 3.0)]


@pytest.mark.parametrize("large", [0, S.LARGE_BLOCK])
def test_places_are_not_broadcast(spark, large):
    """A profile has many places, which the size of the classes' file does not tell; the driver holds none."""
    c = S.stored(S.profile_classes(spark.createDataFrame(rows(), SCHEMA), members=1), "classes")
    plan = S.pairs_within(c, c, 0.1, S.shared_masks(c, large))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan


def test_tiles_leave_no_pair_out(spark, monkeypatch):
    data = [r for r in rows() if r[0] is not None and r[1] is not None]
    edges = lambda: {(e.a, e.b, e.similarity) for e in S.similarity_graph(spark.createDataFrame(data, SCHEMA), 0.9).collect()}
    whole = edges()
    monkeypatch.setattr(S, "TILE", 3)
    assert whole and edges() == whole


def sides(n, seed, **other):
    """A group's rows, n on either side, as the search gets them."""
    rng = np.random.default_rng(seed)
    x = pa.table({"side": np.zeros(n, int), "id": np.arange(n), "n": np.ones(n, int), **{c: rng.random(n) for c in S._VALUES}, "bits": np.full(n, 15), "school": ["a"] * n, "style": pa.nulls(n, pa.string()), "kind": np.zeros(n, int), **other})
    return x, pa.concat_tables([x, x.set_column(0, "side", pa.array(np.ones(n, int)))]).combine_chunks()


@pytest.mark.parametrize("kind", [0, 1, 2])
@pytest.mark.parametrize("best", [None, 5])
def test_a_search_in_small_steps_finds_the_same(monkeypatch, kind, best):
    rng, n = np.random.default_rng(9), 300
    names = [f"s{i}" if i else None for i in rng.integers(0, 9, n)]
    styles = [None if s is None or s > "s6" else "xy"[s > "s3"] for s in names]
    other = {"school": ["a"] * n, "style": ["x"] * n} if kind == 0 else {"school": names, "style": styles if kind == 2 else ["x"] * n}
    _, both = sides(n, 5, bits=rng.integers(0, 16, n), kind=np.full(n, kind), season=rng.integers(2000, 2004, n), bound=pa.nulls(2 * n, pa.float64())[:n], **other)
    search = lambda: sorted(zip(*pa.Table.from_batches(S._searched(0.3, best, pa.int64())(iter(both.to_batches()))).to_pydict().values(), strict=True))
    whole = search()
    if best:  # against all pairs: as many of each row as the best, and what nearly ties
        kept = {}
        for a, _, s in whole:
            kept.setdefault(a, []).append(s)
        t = both.slice(0, n).to_pydict()
        v = np.column_stack([t[c] for c in S._VALUES])
        for a in range(n):
            b = np.array([b for b in range(n) if t["season"][b] < t["season"][a] and (kind == 0 or t["school"][a] is None or t["school"][a] != t["school"][b]) and (kind < 2 or t["style"][a] is None or t["style"][a] != t["style"][b])], int)
            want = np.sort(S._similar(np.repeat(v[[a]], len(b), 0), v[b], np.array(t["bits"])[b] & t["bits"][a], kind))[::-1][:best]
            assert sorted(kept.get(a, []), reverse=True)[:best] == want.tolist()
    for name, size in (("ROWS_AT_ONCE", 7), ("BOXES_AT_ONCE", 16), ("PAIRS_AT_ONCE", 3), ("BOX", 2), ("BOXES", 2)):
        monkeypatch.setattr(S, name, size)
    again = search()
    assert whole and (again == whole if best is None else {(a, s) for a, _, s in again} >= {(a, s) for a, _, s in whole})


def test_tiles_leave_no_comparison_out(spark, monkeypatch):
    df = spark.createDataFrame(rows(), SCHEMA)
    found = lambda: sorted(map(tuple, S.nearest_earlier(df).collect()))
    whole = found()
    monkeypatch.setattr(S, "TILE", 3)
    assert whole and found() == whole


def test_few_pairs_are_looked_at(monkeypatch):
    """Rows meet boxes of near ones: of all pairs of a group few are compared."""
    n = 4000
    x, both = sides(n, 3)
    seen, away = [], S._Boxes.away
    monkeypatch.setattr(S._Boxes, "away", lambda self, v, box: seen.append(len(box) * S.BOX) or away(self, v, box))
    found = pa.Table.from_batches(S._searched(0.03, None, pa.int64())(iter(both.to_batches())))
    v = np.column_stack([x[c] for c in S._VALUES]) * S._SCALES
    want = {(i, j) for i in range(n) for j in np.flatnonzero(np.abs(v[i] - v).sum(1) <= 0.03 + 5e-7) if i < j}
    got = set(zip(found["a"].to_pylist(), found["b"].to_pylist(), strict=True))
    assert sum(seen) < n * n / 3 and len(got) == found.num_rows
    assert all(abs(np.abs(v[i] - v[j]).sum() - 0.03) < 2e-6 for i, j in want ^ got)


def test_similarities_are_rounded_as_spark_rounds(spark):
    x = np.concatenate([np.random.default_rng(4).random(2000), np.arange(1, 400, 2) / 2e6 - 1e-9, np.arange(1, 400, 2) / 2e6, [0.0, 1.0]])
    want = [r[0] for r in spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double").orderBy("i").select(fixed("x")).collect()]
    assert S._rounded(x).tolist() == want


def test_a_mean_of_five_points_is_no_bust(spark, tmp_path):
    """Weeks of whole yards that mean 5 points exactly, whose fifths added up one by one may fall short of it."""
    days = pd.DataFrame({"l_shipdate": pd.date_range("1995-01-01", periods=36, freq="MS").astype("datetime64[us]"), "week": range(36)})
    yards = np.random.default_rng(8).integers(1, 50, (200, 36))
    yards[:, 18:] = 50 - yards[:, :18]
    d = pd.DataFrame({"l_partkey": np.repeat(np.arange(200), 36), "week": np.tile(np.arange(36), 200), "l_quantity": yards.ravel().astype(float)}).merge(days).drop(columns="week")
    d = d.assign(l_suppkey=1, l_orderkey=1, l_linenumber=1, l_discount=0.05, l_extendedprice=1.0, l_returnflag="R", l_linestatus="O")
    spark.createDataFrame(d).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(i, "a bolt", "X", i % 50) for i in range(200)], "p_partkey long, p_name string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    found = registry.QUERIES["prospect_features"](spark, str(tmp_path)).collect()
    assert len(found) > 150 and {r.prospect_comp_bust_rate for r in found} == {0.0}

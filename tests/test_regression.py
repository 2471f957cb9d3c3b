"""Fits on aggregated sums against numpy on the rows, and what share of held-out rows the lines hold."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidelag.operators import regression as R

NAMES = ("a", "b", "c")


def rows(n=1200, gaps=True):
    r = np.random.default_rng(4)
    x = r.normal(size=(n, 3)) * [1, 5, 0.2] + [0, 10, 1]
    season = r.integers(2000, 2005, n)
    y = 3 + x @ [2.0, -0.5, 1.0] + r.normal(size=n) * 1.5
    known = r.random((n, 3)) > (0.15 if gaps else -1)
    return x, known, season, y


@pytest.fixture(scope="module")
def table(spark):
    x, known, season, y = rows()
    data = [(int(s), *[float(v) if k else None for v, k in zip(p, m, strict=True)], float(t)) for p, m, s, t in zip(x, known, season, y, strict=True)]
    return spark.createDataFrame(data + [(2001, 1.0, None, 1.0, None), (None, 1.0, 1.0, 1.0, 1.0)], "season int, a double, b double, c double, y double").repartition(5).cache()


def filled(season):
    """Rows before the season, gaps filled by medians as the fit takes them, columns scaled."""
    x, known, s, y = rows()
    past = s < season
    out = x.copy()
    for k in range(3):
        held = np.sort(x[past & known[:, k], k])
        if k == 1:  # the row without a label has values of a and c
            median = held[(len(held) + 1) // 2 - 1]
        else:
            held = np.sort(np.append(held, 1.0)) if season > 2001 else held
            median = held[(len(held) + 1) // 2 - 1]
        out[~known[:, k], k] = median
    mean, scale = out[past].mean(axis=0), out[past].std(axis=0)
    return (out - mean) / scale, past, s == season, y


def test_evidence_iteration_is_its_closed_form(table):
    folds = R.bayesian_folds(table, NAMES, "y")
    assert [f.season for f in folds] == [2001, 2002, 2003, 2004]
    got = {f.season: R.with_intervals(table, [f], NAMES).orderBy("y").collect() for f in folds}
    for f in folds:
        z, past, now, y = filled(f.season)
        x, t = z[past], y[past] - y[past].mean()
        alpha, lam = 1 / t.var(), 1.0
        for _ in range(300):
            cov = np.linalg.inv(lam * np.eye(3) + alpha * x.T @ x)
            w = alpha * cov @ x.T @ t
            gamma = 3 - lam * np.trace(cov)
            lam = (gamma + 2e-6) / (w @ w + 2e-6)
            alpha = (len(t) - gamma + 2e-6) / (((t - x @ w) ** 2).sum() + 2e-6)
        cov = np.linalg.inv(lam * np.eye(3) + alpha * x.T @ x)
        assert np.allclose(f.weights["w"], w, atol=1e-5) and np.isclose(f.weights["noise"], 1 / alpha, rtol=1e-5) and f.weights["n"] == past.sum()
        order = np.argsort(y[now])
        std = np.sqrt(1 / alpha + np.einsum("ij,jk,ik->i", z[now], cov, z[now]))[order]
        mean = (z[now] @ w + y[past].mean())[order]
        mine = [r for r in got[f.season] if r["y"] is not None]
        assert np.allclose([r["mean"] for r in mine], mean, atol=1e-4) and np.allclose([r["std"] for r in mine], std, atol=1e-4)
    held = [r["floor"] <= r["y"] <= r["ceiling"] for part in got.values() for r in part if r["y"] is not None]
    assert abs(np.mean(held) - 0.8) < 0.03


def test_quantile_lines(table):
    folds = R.quantile_folds(table, NAMES, "y")
    pinball = lambda r, q: np.maximum(q * r, (q - 1) * r).mean()
    for f in folds:
        z, past, _, y = filled(f.season)
        for q, line in f.weights.items():
            loss = pinball(y[past] - line[0] - z[past] @ line[1:], q)
            r = np.random.default_rng(1)
            other = min(pinball(y[past] - (line + d)[0] - z[past] @ (line + d)[1:], q) for d in r.normal(size=(300, 4)) * 0.05)
            assert loss < other + 1e-4
            assert abs((y[past] < line[0] + z[past] @ line[1:]).mean() - q) < 0.02
    out = R.with_quantiles(table, folds, NAMES).where("y IS NOT NULL").collect()
    for c, q in (("q10", 0.1), ("q50", 0.5), ("q90", 0.9)):
        assert abs(np.mean([r["y"] < r[c] for r in out]) - q) < 0.035
    assert all(r["q10"] <= r["q50"] <= r["q90"] for r in out)


def test_small_tables(table):
    assert R.bayesian_folds(table.limit(0), NAMES, "y") == [] and R.quantile_folds(table.where("season = 2001"), NAMES, "y") == []
    flat = table.withColumn("a", F.lit(2.0)).withColumn("b", F.lit(None).cast("double"))
    f = R.bayesian_folds(flat, NAMES, "y")[-1]
    assert abs(f.weights["w"][0]) < 1e-9 and abs(f.weights["w"][1]) < 1e-9
    assert R.with_intervals(flat, [f], NAMES).where("mean IS NULL OR std IS NULL").count() == 0


def test_a_task_of_a_quantile_step_hands_on_one_row_a_line():
    fold = R.Fold(2003, np.array([5.0]), np.array([1.0]), np.array([2.0]), {})
    rows = pa.RecordBatch.from_arrays([pa.array([2001, 2002, 2003]), pa.array([1.0, 2.0, 3.0]), pa.array([None, 3.0, 9.0])], names=["s", "y", "x0"])
    got = list(R._pinball_sums([(fold, [(0.1, np.array([0.5, 0.0]), 0.5), (0.9, np.zeros(2), 1.0)])])(iter([rows] * 3)))
    assert [b.num_rows for b in got] == [2] and got[0].column("q").to_pylist() == [0.1, 0.9]
    x, y = np.array([[1.0, 2.0], [1.0, 1.0]]), np.array([1.0, 2.0])
    w = 1 / (0.5 + np.abs(y - 0.5))
    want = np.concatenate([(x.T * w @ x).ravel(), x.T @ (w * y), x.sum(axis=0)]) * 3
    assert np.allclose([got[0].column(f"v{i}")[0].as_py() for i in range(8)], want)
    assert list(R._pinball_sums([(fold, [(0.1, np.zeros(2), 1.0)])])(iter([]))) == []

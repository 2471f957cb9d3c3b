"""Linear models of every season from all earlier ones, fitted on sums that Spark aggregates.

A fold is a season that is predicted from those before it. Only sums over rows come to the driver, one small
matrix a season, fold or quantile; rows are read once for all Bayesian fits, and once a step for all quantiles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 10 and 90 in 100 of a normal distribution lie below mean -+ so many deviations.
TENTH = 1.2815515655446004
#: Residuals below this share of the label's deviation count as one so large in a quantile fit.
SMOOTH = 1e-3
#: Exactness of medians: the error of a rank is below 1 in so many rows.
MEDIAN_ACCURACY = 10_000


@dataclass
class Fold:
    """What one season is predicted with: medians for gaps, means and deviations to scale by, weights by name."""

    season: int
    median: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: dict


def known_seasons(df: DataFrame, season: str = "season") -> list[int]:
    """The seasons in order: a row each."""
    return sorted(r[0] for r in df.where(F.col(season).isNotNull()).select(season).distinct().collect())


def earlier_medians(df: DataFrame, features: Sequence[str], seasons: Sequence[int], season: str = "season") -> dict[int, np.ndarray]:
    """For each season the features' medians over all earlier ones, in one pass; 0 where a feature has no value yet."""
    cells = [F.percentile_approx(F.when(F.col(season) < s, F.col(c).cast("double")), 0.5, MEDIAN_ACCURACY).alias(f"m{i}_{k}") for i, s in enumerate(seasons) for k, c in enumerate(features)]
    r = df.agg(*cells).first()
    return {s: np.array([r[f"m{i}_{k}"] or 0.0 for k in range(len(features))]) for i, s in enumerate(seasons)}


def _moments(df: DataFrame, features: Sequence[str], label: str, season: str) -> dict[int, list[tuple[np.ndarray, np.ndarray]]]:
    """By season: pairs of a pattern of known features and the sums of products of 1, features and label, gaps counting 0.

    Patterns of gaps are kept apart, so that any median can be put into the gaps afterwards.
    """
    named = ["__one", *features, "__y"]
    rows = df.where(F.col(label).isNotNull() & F.col(season).isNotNull()).select(season, F.lit(1.0).alias("__one"), *[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("double").alias("__y"))
    pattern = F.array(*[F.col(c).isNotNull() for c in features]).alias("__known")
    whole = {c: F.coalesce(c, F.lit(0.0)) for c in named}
    products = [F.sum(whole[a] * whole[b]).alias(f"s{i}_{j}") for i, a in enumerate(named) for j, b in enumerate(named) if i <= j]
    out: dict[int, list] = {}
    for r in rows.groupBy(season, pattern).agg(*products).collect():  # as many rows as seasons have patterns of gaps
        m = np.array([[r[f"s{min(i, j)}_{max(i, j)}"] for j in range(len(named))] for i in range(len(named))])
        out.setdefault(r[season], []).append((np.array(r["__known"]), m))
    return out


def _filled(known: np.ndarray, m: np.ndarray, median: np.ndarray) -> np.ndarray:
    """Sums of products as they are with the medians in the gaps of the pattern."""
    put = np.eye(len(m))
    for k in np.flatnonzero(~known):
        put[k + 1, 0] = median[k]  # a gap is the median times the column of ones
    return put @ m @ put.T


def evidence_fit(gram: np.ndarray, xy: np.ndarray, yy: float, n: int, steps: int = 300, tolerance: float = 1e-6, prior: float = 1e-6) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights, their covariance and the noise variance of Bayesian ridge regression, by evidence iteration.

    gram, xy and yy are sums of products of centred columns. Noise and weights have gamma priors of shape and
    rate `prior`; both precisions are fitted until the weights stay within the tolerance.
    """
    values, vectors = np.linalg.eigh(gram)
    values = np.maximum(values, 0.0)
    along = vectors.T @ xy
    noise, own, before = 1.0 / max(yy / max(n, 1), 1e-12), 1.0, None
    for _ in range(steps):
        coefficients = noise * along / (own + noise * values)
        known = float((noise * values / (own + noise * values)).sum())
        left = max(yy - 2 * coefficients @ along + coefficients @ (values * coefficients), 0.0)
        own = (known + 2 * prior) / (coefficients @ coefficients + 2 * prior)
        noise = (n - known + 2 * prior) / (left + 2 * prior)
        if before is not None and np.abs(coefficients - before).sum() < tolerance:
            break
        before = coefficients
    coefficients = noise * along / (own + noise * values)
    covariance = (vectors / (own + noise * values)) @ vectors.T
    return vectors @ coefficients, covariance, 1.0 / noise


def bayesian_folds(df: DataFrame, features: Sequence[str], label: str, season: str = "season") -> list[Fold]:
    """A Bayesian ridge fit for each season but the first, on all rows of earlier seasons with a label.

    Gaps get the median of earlier seasons; features are scaled to mean 0 and deviation 1. A feature that never
    changes has no weight. weights: w, covariance, noise (variance), base (mean label), n.
    """
    seasons = known_seasons(df, season)
    if len(seasons) < 2:
        return []
    medians, moments, out = earlier_medians(df, features, seasons[1:], season), _moments(df, features, label, season), []
    for s in seasons[1:]:
        past = [_filled(known, m, medians[s]) for q, parts in moments.items() if q < s for known, m in parts]
        if not past:
            continue
        m = np.sum(past, axis=0)
        n = m[0, 0]
        mean = m[0, 1:] / n
        centred = m[1:, 1:] - n * np.outer(mean, mean)
        scale = np.sqrt(np.maximum(np.diag(centred)[:-1] / n, 0.0))
        scale = np.where(scale > 1e-9 * (1 + np.abs(mean[:-1])), scale, np.inf)
        w, covariance, noise = evidence_fit(centred[:-1, :-1] / np.outer(scale, scale), centred[:-1, -1] / scale, centred[-1, -1], int(n))
        out.append(Fold(s, medians[s], mean[:-1], scale, {"w": w, "covariance": covariance, "noise": noise, "base": mean[-1], "n": int(n)}))
    return out


def _scaled(features: Sequence[str], f: Fold) -> list[Column]:
    return [(F.coalesce(F.col(c).cast("double"), F.lit(float(f.median[k]))) - float(f.mean[k])) / float(f.scale[k]) if np.isfinite(f.scale[k]) else F.lit(0.0) for k, c in enumerate(features)]


def _dot(x: list[Column], w: np.ndarray) -> Column:
    return sum((c * float(v) for c, v in zip(x, w, strict=True)), F.lit(0.0))


def _by_fold(folds: Sequence[Fold], season: str, value) -> Column:
    out = F.lit(None)
    for f in folds:
        out = F.when(F.col(season) == f.season, value(f)).otherwise(out)
    return out


def with_intervals(df: DataFrame, folds: Sequence[Fold], features: Sequence[str], season: str = "season") -> DataFrame:
    """Rows of the folds' seasons with mean, std, floor and ceiling (10 and 90 in 100) of the predictive distribution.

    The variance of a row is the noise's and that of the weights along the row, all as column expressions. Columns of
    df with these names are replaced.
    """
    kept = [c for c in df.columns if c not in ("mean", "std", "floor", "ceiling")]

    def predicted(f: Fold) -> Column:
        x = _scaled(features, f)
        spread = sum((x[i] * _dot(x, f.weights["covariance"][i]) for i in range(len(x))), F.lit(float(f.weights["noise"])))
        return F.struct((_dot(x, f.weights["w"]) + float(f.weights["base"])).alias("mean"), F.sqrt(spread).alias("std"))

    out = df.where(F.col(season).isin([f.season for f in folds])).withColumn("__p", _by_fold(folds, season, predicted))
    mean, std = F.col("__p.mean"), F.col("__p.std")
    return out.select(*kept, mean.alias("mean"), std.alias("std"), (mean - TENTH * std).alias("floor"), (mean + TENTH * std).alias("ceiling"))


def _pinball_sums(asked: list[tuple[Fold, list[tuple[float, np.ndarray, float]]]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's sums of a step of quantile fits: for each fold and its (quantile, line, least residual) one row of sums.

    Sums are of w x x', w y x and x over rows of earlier seasons, w being 1 over the size of the residual.
    """
    plain = [(f.season, f.median, f.mean, f.scale, lines) for f, lines in asked]  # workers need no class of this module

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, float], np.ndarray] = {}
        for batch in batches:
            s, y, *cells = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            gaps = [c.is_null().to_numpy(zero_copy_only=False) for c in batch.columns[2:]]
            for season, median, mean, scale, lines in plain:
                past = s < season
                if not past.any():
                    continue
                x = np.column_stack([np.ones(len(s)), *[(np.where(g, m, c) - a) / d if np.isfinite(d) else np.zeros(len(s)) for c, g, m, a, d in zip(cells, gaps, median, mean, scale, strict=True)]])[past]
                own = y[past]
                for q, line, least in lines:
                    w = 1 / (least + np.abs(own - x @ line))
                    part = np.concatenate([(x.T @ (x * w[:, None])).ravel(), x.T @ (w * own), x.sum(axis=0)])
                    found[season, q] = found.get((season, q), 0.0) + part
        if found:
            folds, qs = zip(*found, strict=True)
            values = np.array(list(found.values()))
            yield pa.RecordBatch.from_arrays([pa.array(folds, pa.int64()), pa.array(qs, pa.float64()), *map(pa.array, values.T)], names=["fold", "q", *[f"v{i}" for i in range(values.shape[1])]])

    return sums


def quantile_folds(df: DataFrame, features: Sequence[str], label: str, quantiles: Sequence[float] = (0.1, 0.5, 0.9), season: str = "season", steps: int = 60, tolerance: float = 1e-4) -> list[Fold]:
    """For each season but the first, linear quantile fits on all rows of earlier seasons with a label.

    The pinball loss is lowered by reweighted least squares: a row weighs 1 over the size of its residual, and each
    step's sums, of all folds and quantiles at once, are one pass over the rows, which should be a stored table; a
    task adds them up in arrays and hands on one small row a line. Ends when no line moves by more than the
    tolerance, in deviations of the label, or after `steps`.
    """
    folds = bayesian_folds(df, features, label, season)
    if not folds:
        return []
    k = len(features) + 1
    lines = {(f.season, q): np.concatenate([[f.weights["base"] + TENTH * np.sqrt(f.weights["noise"]) * np.sign(q - 0.5)], f.weights["w"]]) for f in folds for q in quantiles}
    spread = {f.season: max(np.sqrt(f.weights["noise"]), 1e-12) for f in folds}
    known = df.where(F.col(label).isNotNull() & F.col(season).isNotNull())
    rows = known.select(F.col(season).cast("long").alias("s"), F.col(label).cast("double").alias("y"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)])
    size = k * k + 2 * k
    schema, totals = "fold long, q double, " + ", ".join(f"v{i} double" for i in range(size)), [F.sum(f"v{i}").alias(f"v{i}") for i in range(size)]
    open_lines = set(lines)
    for _ in range(steps):
        asked = [(f, [(q, lines[f.season, q], SMOOTH * spread[f.season]) for q in quantiles if (f.season, q) in open_lines]) for f in folds]
        parts = rows.mapInArrow(_pinball_sums([(f, qs) for f, qs in asked if qs]), schema)
        for r in parts.groupBy("fold", "q").agg(*totals).collect():  # one small matrix a line
            v = np.array(r[2:])
            gram, right = v[: k * k].reshape(k, k), v[k * k : k * k + k] + (2 * r["q"] - 1) * v[k * k + k :]
            new = np.linalg.lstsq(gram, right, rcond=1e-10)[0]
            at = (r["fold"], r["q"])
            if np.abs(new - lines[at]).max() < tolerance * spread[r["fold"]]:
                open_lines.discard(at)
            lines[at] = new
        if not open_lines:
            break
    return [Fold(f.season, f.median, f.mean, f.scale, {q: lines[f.season, q] for q in quantiles}) for f in folds]


def with_quantiles(df: DataFrame, folds: Sequence[Fold], features: Sequence[str], season: str = "season") -> DataFrame:
    """Rows of the folds' seasons with a column a quantile, such as q10; crossing lines are put in order."""
    if not folds:
        return df.limit(0)
    qs = sorted(folds[0].weights)
    line = lambda f: F.array(*[_dot(_scaled(features, f), f.weights[q][1:]) + float(f.weights[q][0]) for q in qs])
    out = df.where(F.col(season).isin([f.season for f in folds])).withColumn("__q", F.array_sort(_by_fold(folds, season, line)))
    return out.select(*df.columns, *[F.col("__q")[i].alias(f"q{round(100 * q):02d}") for i, q in enumerate(qs)])

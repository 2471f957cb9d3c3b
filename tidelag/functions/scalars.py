"""Scalar expressions: rounding, division, buckets, odds, distances, names. All stay in generated code."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(x: str | Column, digits: int = 6) -> Column:
    """x rounded, with a nudge of 1e-9 so that engines agree on values that sit on a tie."""
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x + F.lit(1e-9), digits)


def correlation(x: str, y: str, times: str) -> Column:
    """Aggregate: Pearson correlation of rows that each stand for `times` equal ones; null where x or y never changes."""
    total = lambda c: F.sum(F.col(times) * c)
    n, a, b = F.sum(times), F.col(x).cast("double"), F.col(y).cast("double")
    apart = lambda p, q: n * total(p * q) - total(p) * total(q)
    changes = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return F.when(changes, apart(a, b) / (F.sqrt(apart(a, a)) * F.sqrt(apart(b, b))))


def ratio(a: str | Column, b: str | Column, empty: float | None = None) -> Column:
    """a / b where b is not 0, else `empty`."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.when(b != 0, a / b).otherwise(F.lit(empty).cast("double"))


def clip(x: Column, low: float, high: float) -> Column:
    """x within limits; null stays null, unlike least() and greatest() alone."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(float(high))), F.lit(float(low))))


def bucket(x: str, edges: Sequence[float], names: Sequence[str], right: bool = True) -> Column:
    """Name of the bin (edge, next] that holds x, [edge, next) for right=False; null outside."""
    c, out = F.col(x), F.lit(None).cast("string")
    for low, high, n in reversed(list(zip(edges[:-1], edges[1:], names, strict=True))):
        inside = (c > low) & (c <= high) if right else (c >= low) & (c < high)
        out = F.when(inside, F.lit(n)).otherwise(out)
    return out


def american_probability(odds: str | Column) -> Column:
    """Implied probability of American odds; null for 0 and null."""
    o = F.col(odds) if isinstance(odds, str) else odds
    return F.when(o > 0, 100.0 / (o + 100.0)).when(o < 0, -o / (-o + 100.0))


def devig(p: Column, q: Column) -> Column:
    """Share of p in p + q."""
    return F.when(p + q > 0, p / (p + q))


def implied_pair(total: Column, spread: Column, low: float = 5.0, high: float = 45.0) -> tuple[Column, Column]:
    """Both sides' implied points from a total and the home side's expected margin."""
    return clip(total / 2 + spread / 2, low, high), clip(total / 2 - spread / 2, low, high)


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere of 3958.8 miles radius, from degrees."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * 3958.8 * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function by a rational approximation; error below 1e-7."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def normal_quantile(p: Column, limit: float | None = None) -> Column:
    """Inverse of the normal distribution function by a rational approximation; error below 4.5e-4."""
    q = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    t = F.sqrt(-2 * F.log(F.least(q, 1 - q)))
    z = t - (2.515517 + t * (0.802853 + t * 0.010328)) / (1 + t * (1.432788 + t * (0.189269 + t * 0.001308)))
    z = F.when(q < 0.5, -z).otherwise(z)
    return z if limit is None else clip(z, -limit, limit)


def implied_mean(line: Column, p_over: Column, cv: float) -> Column:
    """Mean of a normal stat with deviation cv * mean whose chance to pass the line is p_over.

    The quantile is kept within one deviation and the divisor above 0.1; null where either is null.
    """
    z = normal_quantile(clip(p_over, 0.01, 0.99), limit=1.0)
    return F.when(p_over.isNotNull(), line / F.greatest(1 - cv * z, F.lit(0.1)))


def ladder_mean(rungs: Sequence[float], probs: Sequence[Column], cv: float | None = None) -> Column:
    """Struct of err and mean: the mean, in hundredths up to twice the top rung, that fits a ladder of P(X >= rung) best.

    X is normal with deviation cv * mean, or Poisson without cv. The squared error is searched in steps of
    1, 0.1 and 0.01 around the best so far.
    """
    top = float(max(rungs))

    def tail(t: float, mu: Column) -> Column:
        if cv is not None:
            return 1 - normal_cdf((t - mu) / (cv * mu))
        terms = [F.pow(mu, F.lit(float(i))) / float(math.factorial(i)) for i in range(int(t))]
        return 1 - F.exp(-mu) * sum(terms[1:], terms[0])

    def tried(mu: Column) -> Column:
        errors = [F.pow(tail(t, mu) - p, F.lit(2.0)) for t, p in zip(rungs, probs, strict=True)]
        return F.struct(sum(errors[1:], errors[0]).alias("err"), mu.alias("mean"))

    def closer(best: Column, step: Column) -> Column:
        n = F.when(step == 1.0, F.lit(int(top))).otherwise(10)
        places = F.transform(F.sequence(-n, n), lambda i: F.least(F.greatest(F.round(best["mean"] + i * step, 2), F.lit(0.01)), F.lit(2 * top)))
        return F.array_min(F.transform(places, tried))

    start = F.struct(F.lit(1e9).alias("err"), F.lit(top).alias("mean"))
    return F.aggregate(F.array(*[F.lit(x) for x in (1.0, 0.1, 0.01)]), start, closer)


def crosses(a: Column, b: Column, numbers: Sequence[float]) -> Column:
    """Whether one of the numbers lies above one of a and b and not above the other."""
    found = [(a < k) != (b < k) for k in numbers]
    out = found[0]
    for x in found[1:]:
        out = out | x
    return out


def saturating_weight(n: Column, k: float, most: int) -> Column:
    """(1 - e^-kn) / (1 - e^-kN), at most 1."""
    return F.least((1 - F.exp(-k * n)) / (1 - math.exp(-k * most)), F.lit(1.0))


def decay(age_hours: Column, half_life: float, cutoff: float) -> Column:
    """0.5 ** (age / half_life); 1 for the future, 0 beyond the cutoff."""
    return F.when(age_hours > cutoff, F.lit(0.0)).otherwise(F.pow(F.lit(0.5), F.greatest(age_hours, F.lit(0.0)) / half_life))


def piecewise_multiplier(s: Column, up: float, down: float) -> Column:
    """1 at 0, `up` at 1 and `down` at -1, straight between."""
    return F.when(s >= 0, 1 + s * (up - 1)).otherwise(1 + s * (1 - down))


def linear_score(weights: dict[str, float], digits: int = 2) -> Column:
    """Weighted sum of columns, nulls counting 0."""
    total = F.lit(0.0)
    for c, w in weights.items():
        total = total + F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w
    return fixed(total, digits)


def normal_name(name: Column) -> Column:
    """Lower case, generational suffix off, hyphens to spaces, letters only, single spaces."""
    n = F.regexp_replace(F.lower(name), "-", " ")
    n = F.regexp_replace(n, r"\b(jr|sr|ii|iii|iv|v)\b\.?\s*$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(n, "[^a-z ]", ""), " +", " "))


def token_jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct tokens of two token arrays; 0 for two empty ones."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def inches(height: Column) -> Column:
    """Inches of a height such as 5-11; null if it is not written so."""
    feet, inch = (F.regexp_extract(height, r"^\s*(\d+)-(\d+)\s*$", i) for i in (1, 2))
    return F.when(feet != "", feet.cast("int") * 12 + inch.cast("int"))


def minutes_seconds(clock: Column) -> Column:
    """Seconds of a duration such as 7:05; null if it is not written so."""
    m, s = (F.regexp_extract(clock, r"^(\d+):(\d{1,2})$", i) for i in (1, 2))
    return F.when(m != "", m.cast("int") * 60 + s.cast("int"))

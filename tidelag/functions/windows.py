"""Leak-free window columns: every frame of a lagged function ends one row before the current one.

Positional frames count rows, so a missing week is skipped; calendar frames count weeks. Columns over one
window spec share one sort when they are put in one select.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Rows of history that an exponentially weighted mean looks at; at half-life 3 the rest weighs under 1e-6.
EWM_ROWS = 60


def by(keys: Sequence[str], order: Sequence[str | Column]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def _guarded(value: Column, counted: Column, min_periods: int) -> Column:
    return value if min_periods <= 1 else F.when(counted >= min_periods, value)


def lagged_mean(x: str | Column, w: WindowSpec, n: int | None = None, min_periods: int = 1) -> Column:
    """Mean of the n rows before this one, all of them for None; null where fewer than min_periods hold a value."""
    x = F.col(x) if isinstance(x, str) else x
    frame = w.rowsBetween(Window.unboundedPreceding if n is None else -n, -1)
    return _guarded(F.avg(x).over(frame), F.count(x).over(frame), min_periods)


def lagged_sum(x: str | Column, w: WindowSpec, n: int | None = None) -> Column:
    """Sum of the n rows before this one, all of them for None; null where there is none."""
    x = F.col(x) if isinstance(x, str) else x
    return F.sum(x).over(w.rowsBetween(Window.unboundedPreceding if n is None else -n, -1))


def calendar_sum(x: str | Column, w: WindowSpec, n: int) -> Column:
    """Sum over the n weeks before this row's; w is ordered by the week number alone."""
    x = F.col(x) if isinstance(x, str) else x
    return F.sum(x).over(w.rangeBetween(-n, -1))


def lagged_ewm(x: str, w: WindowSpec, half_life: float) -> Column:
    """Exponentially weighted mean of earlier rows; a null keeps its distance but has no weight."""
    past = F.collect_list(F.struct(F.col(x).alias("v"))).over(w.rowsBetween(-EWM_ROWS, -1))
    n = F.size(past)
    terms = F.transform(past, lambda s, i: F.struct(F.pow(F.lit(0.5), (n - 1 - i) / half_life).alias("w"), s["v"].alias("v")))
    known = F.filter(terms, lambda t: t["v"].isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda a, t: a + t["w"])
    weighted = F.aggregate(known, F.lit(0.0), lambda a, t: a + t["w"] * t["v"])
    return F.when(total > 0, weighted / total)


def lagged_slope(x: str, w: WindowSpec, n: int, min_periods: int = 3) -> Column:
    """Least-squares slope of the n earlier rows over their dense index among non-null values."""
    frame = w.rowsBetween(-n, -1)
    past = F.filter(F.collect_list(F.struct(F.col(x).alias("v"))).over(frame), lambda s: s["v"].isNotNull())
    k = F.size(past)
    mean_i = (k - 1) / 2
    up = F.aggregate(F.transform(past, lambda s, i: (i - mean_i) * s["v"]), F.lit(0.0), lambda a, t: a + t)
    down = F.aggregate(F.transform(past, lambda s, i: (i - mean_i) * (i - mean_i)), F.lit(0.0), lambda a, t: a + t)
    return F.when((k >= min_periods) & (down > 0), up / down)


def share(x: str | Column, *keys: str) -> Column:
    """x over its sum in the group; null where the sum is 0."""
    x = F.col(x) if isinstance(x, str) else x
    total = F.sum(x).over(Window.partitionBy(*keys))
    return F.when(total != 0, x / total)


def to_group_mean(x: str | Column, *keys: str) -> tuple[Column, Column]:
    """Ratio and difference of x to its mean in the group."""
    x = F.col(x) if isinstance(x, str) else x
    mean = F.avg(x).over(Window.partitionBy(*keys))
    return F.when(mean != 0, x / mean), x - mean


def rank_average(w: WindowSpec, ties: WindowSpec) -> Column:
    """Rank of which ties get the mean; ties partitions by the keys and the ranked value."""
    return F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2


def with_rank_averages(df: DataFrame, keys: Sequence[str], names: dict[str, str], times: str | None = None) -> DataFrame:
    """df with a column for each of names: rank_average() of its key among the rows of the group, nulls first.

    times counts how often a row stands for itself. A window over rows would sort a whole group in one task. Here each
    value is counted once a group; values are ranked in parts of one unit, and parts by their totals.
    """
    out, earlier = df, lambda w: F.coalesce(F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    for x, name in names.items():
        whole = F.col(x).cast("double")
        part = F.when(F.isnan(whole), F.lit(2**63 - 1)).otherwise(F.floor(whole))
        counts = df.groupBy(*keys, x).agg((F.count("*") if times is None else F.sum(times)).alias("__c")).withColumn("__part", part)
        totals = counts.groupBy(*keys, "__part").agg(F.sum("__c").alias("__c"))
        renamed = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
        same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
        before = totals.select(*renamed, F.col("__part").alias("__p"), earlier(by(keys, ("__part",))).alias("__before"))
        placed = counts.withColumn("__own", earlier(by((*keys, "__part"), (x,)))).join(before, [*same, F.col("__part").eqNullSafe(F.col("__p"))]).select(*keys, x, "__c", "__own", "__before")
        ranks = placed.select(*renamed, F.col(x).alias("__x"), (F.col("__before") + F.col("__own") + (F.col("__c") + 1) / 2).alias(name))
        out = out.join(ranks, [*same, F.col(x).eqNullSafe(F.col("__x"))]).select(*out.columns, name)
    return out


def rank_percent(w: WindowSpec, ties: WindowSpec, group: WindowSpec) -> Column:
    """Average rank over the group's size, 1 for the last."""
    return rank_average(w, ties) / F.count(F.lit(1)).over(group)


def zscore(x: str, *keys: str, clip: float = 3.0, least: int = 3) -> Column:
    """Clipped z-score in the group; null with fewer than `least` values or without spread."""
    g = Window.partitionBy(*keys)
    sd = F.stddev_samp(x).over(g)
    z = (F.col(x) - F.avg(x).over(g)) / sd
    return F.when((F.count(x).over(g) >= least) & (sd > 0), F.greatest(F.least(z, F.lit(clip)), F.lit(-clip)))


def islands(df: DataFrame, starts: Column, w: WindowSpec, name: str) -> DataFrame:
    """df with `name`: number of rows up to this one at which `starts` holds; equal numbers are one island."""
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def signed_streak(df: DataFrame, sign: str, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """df with `name`: length of the run of equal signs that ends one row earlier, times that sign; 0 at first."""
    w = by(keys, order)
    before = F.lag(sign).over(w)
    d = islands(df, before.isNull() | (before != F.col(sign)), w, "__island")
    d = d.withColumn("__run", F.row_number().over(by([*keys, "__island"], order)) * F.col(sign))
    return d.withColumn(name, F.coalesce(F.lag("__run").over(w), F.lit(0))).drop("__island", "__run")


def lagged_product(p: str | Column, w: WindowSpec) -> Column:
    """Product of earlier rows' positive factors, 1 at first; 0 once a factor was 0."""
    p = F.col(p) if isinstance(p, str) else p
    frame = w.rowsBetween(Window.unboundedPreceding, -1)
    dead = F.max(F.when(p <= 0, 1).otherwise(0)).over(frame)
    return F.when(F.coalesce(dead, F.lit(0)) == 1, F.lit(0.0)).otherwise(F.exp(F.coalesce(F.sum(F.when(p > 0, F.log(p))).over(frame), F.lit(0.0))))


def decreasing_envelope(x: str, place: str, w: WindowSpec, step: float) -> Column:
    """Largest curve below x that falls by `step` or more at each place."""
    up = F.min(F.col(x) + F.col(place) * step).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return up - F.col(place) * step


def lagged_median(x: str | Column, w: WindowSpec, n: int, min_periods: int = 1) -> Column:
    """Median of the n rows before this one; every row sorts its frame anew, so n is a small number."""
    x = F.col(x) if isinstance(x, str) else x
    frame = w.rowsBetween(-n, -1)
    return _guarded(F.percentile(x, 0.5).over(frame), F.count(x).over(frame), min_periods)


def with_prior_median(df: DataFrame, x: str, keys: Sequence[str], time: str, n: int, name: str) -> DataFrame:
    """df with `name`: median of x over all rows of the group whose time is one of the n before this row's.

    A frame over the group's rows would sort them once a row, in one task. Here each value is counted once a
    group and time, counts go to the n times after it, and a time's median is taken from counts.
    """
    counts = df.where(F.col(x).isNotNull()).groupBy(*keys, time, x).agg(F.count("*").alias("__n"))
    later = counts.withColumn(time, F.explode(F.sequence(F.col(time) + 1, F.col(time) + n)))
    medians = later.groupBy(*keys, time).agg(F.percentile(x, 0.5, F.col("__n")).alias(name))
    return df.join(medians, [*keys, time], "left")

"""Joins that Spark has no single operator for: as-of, range, fallback keys, rosters' differences, sides of games."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Token sets up to this size are looked up by three tokens at once where the similarity allows it.
TRIPLES = 16
#: Rows that dealt() gives to a task, about.
DEALT_ROWS = 500_000


def both_sides(games: DataFrame, shared: Sequence[str], pairs: dict[str, tuple[str, str]], flag: str = "is_home") -> DataFrame:
    """Two rows per game: pairs maps a column to its home and away columns, which swap for the second row.

    One scan, no shuffle: an array of two structs is exploded.
    """
    side = lambda i: F.struct(*[F.col(p[i]).alias(c) for c, p in pairs.items()], F.lit(i == 0).alias(flag))
    return games.select(*shared, F.explode(F.array(side(0), side(1))).alias("__s")).select(*shared, "__s.*")


def dealt(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df dealt out by keys, as many tasks as its rows need: for sums over groups that are nearly as many as the rows.

    The tasks that read add nothing up then, and those behind the shuffle hold about DEALT_ROWS rows at any
    size. A sum by keys and more columns, and one by keys over it, need no further shuffle. Rows are
    counted first, which Parquet's footers tell.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // DEALT_ROWS))
    return df.repartition(tasks, *keys)


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, values: Sequence[str], strict: bool = True) -> DataFrame:
    """left with the values of the latest right row before left_time (at it too for strict=False), else nulls.

    Both sides are laid in one sequence per key and the last right row is carried on: one shuffle, one
    sort, and no pair is made, however many right rows a key has. Rows with a null time on the right give
    nothing; ties on the right go to the largest values.
    """
    w = Window.partitionBy(*keys).orderBy(F.col("__t").asc_nulls_first(), "__right_first", *[f"__s.{v}" for v in values])
    value = F.struct(*[F.col(v) for v in values])
    l = left.select(*[F.col(c) for c in left.columns], F.col(left_time).alias("__t"), F.lit(0 if strict else 2).alias("__right_first"))
    r = right.where(F.col(right_time).isNotNull()).select(*keys, F.col(right_time).alias("__t"), F.lit(1).alias("__right_first"), value.alias("__s"))
    both = l.withColumn("__left", F.lit(True)).unionByName(r.withColumn("__left", F.lit(False)), allowMissingColumns=True)
    past = F.last("__s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = both.withColumn("__p", past).where("__left")
    return out.select(*[F.col(c) for c in left.columns], *[F.col(f"__p.{v}").alias(v) for v in values])


def prior_range(left: DataFrame, right: DataFrame, keys: Sequence[str], week: str, n: int, aggregates: Sequence[Column]) -> DataFrame:
    """left joined with aggregates of right's rows of the n weeks before left's; keys and week on both sides."""
    r = right.select(*[F.col(c).alias(f"__r_{c}") if c in (*keys, week) else F.col(c) for c in right.columns])
    l = left.select(*keys, week).distinct()
    on = [l[k] == r[f"__r_{k}"] for k in keys] + [(r[f"__r_{week}"] >= l[week] - n) & (r[f"__r_{week}"] < l[week])]
    found = l.join(r, on, "left").groupBy(*[l[k] for k in keys], l[week]).agg(*aggregates)
    return left.join(found, [*keys, week], "left")


def fallback(left: DataFrame, right: DataFrame, first: str, second: str, values: Sequence[str]) -> DataFrame:
    """left with right's values by key `first`, and by key `second` for rows that `first` does not find.

    right is reduced to one row per key before each join, the smallest values first, so rows never multiply.
    """
    rank = lambda k: F.row_number().over(Window.partitionBy(k).orderBy(*values))

    def side(k: str, tag: str) -> DataFrame:
        one = right.where(F.col(k).isNotNull()).withColumn("__n", rank(k)).where("__n = 1")
        return one.select(F.col(k), F.struct(*values).alias(tag))

    both = left.join(side(first, "__a"), first, "left").join(side(second, "__b"), second, "left")
    got = F.coalesce("__a", "__b")
    how = F.when(F.col("__a").isNotNull(), first).when(F.col("__b").isNotNull(), second).otherwise("none")
    return both.select(*[F.col(c) for c in left.columns], *[got[v].alias(v) for v in values], how.alias("matched_by"))


def departures_arrivals(before: DataFrame, after: DataFrame, keys: Sequence[str], group: str) -> DataFrame:
    """keys, left_group, joined_group for keys whose group changed, ended or began; one full join."""
    b, a = before.select(*keys, F.col(group).alias("left_group")).distinct(), after.select(*keys, F.col(group).alias("joined_group")).distinct()
    return b.join(a, list(keys), "full").where(~F.col("left_group").eqNullSafe(F.col("joined_group")))


def coverage(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: number of keys only in a, only in b, in both."""
    l, r = a.select(*keys).distinct().withColumn("__a", F.lit(1)), b.select(*keys).distinct().withColumn("__b", F.lit(1))
    both = l.join(r, list(keys), "full")
    count = lambda c: F.count_if(c).alias
    return both.agg(count(F.col("__b").isNull())("left_only"), count(F.col("__a").isNull())("right_only"), count(F.col("__a").isNotNull() & F.col("__b").isNotNull())("both"))


def fuzzy_by_token(left: DataFrame, right: DataFrame, tokens: str, least: float) -> DataFrame:
    """Pairs whose token sets reach a Jaccard similarity, each once.

    left and right have `id` and an array `tokens`. Only pairs that share one of the rarest tokens meet:
    a set of n tokens is looked up by its n - ceil(least * n) + 1 rarest, which loses no pair. Above a similarity
    of two thirds, sets of at most TRIPLES tokens share three of their n - ceil(least * n) + 3 rarest, or are equal sets of
    one or two tokens, so they meet by three at once: where all tokens are frequent, few pairs are made.
    """
    from tidelag.functions.scalars import token_jaccard

    l, r = (d.select(F.col("id").alias(f"id{x}"), F.array_distinct(F.coalesce(tokens, F.array())).alias(f"t{x}")) for d, x in ((left, "a"), (right, "b")))
    each = l.select(F.explode("ta").alias("token")).union(r.select(F.explode("tb").alias("token")))
    freq = each.groupBy("token").agg(F.count("*").alias("c"))

    def prefix(d: DataFrame, x: str) -> DataFrame:
        e = d.select(f"id{x}", F.size(f"t{x}").alias("n"), F.explode(f"t{x}").alias("token")).join(freq, "token")
        if 3 * least > 2:
            return threes(e, x)
        place = F.row_number().over(Window.partitionBy(f"id{x}").orderBy("c", "token"))
        return e.withColumn("p", place).where(F.col("p") <= F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1).select(f"id{x}", "token", F.col("n").alias(f"n{x}"))

    def threes(e: DataFrame, x: str) -> DataFrame:
        """Hashes of three tokens as `token`; sets that may meet one of more than TRIPLES tokens give single ones, too."""
        sets = e.groupBy(f"id{x}", "n").agg(F.array_sort(F.collect_list(F.struct("c", "token"))).alias("s"))
        spare = F.col("n") - F.ceil(F.lit(least) * F.col("n"))
        head = lambda k: F.slice("s.token", 1, (spare + k).cast("int"))
        most = max(n - math.ceil(least * n) for n in range(1, TRIPLES + 1)) + 3
        three = [F.when((F.lit(t == (0, 1, 2)) | (F.size("h") > t[2])) & (F.col("n") <= TRIPLES), F.xxhash64(*[F.get("h", i) for i in t])) for t in combinations(range(most), 3)]
        one = F.when(F.col("n") >= least * (TRIPLES + 1), F.transform(head(1), lambda w: F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))
        keys = sets.select(f"id{x}", "n", head(3).alias("h"), one.alias("o")).select(f"id{x}", "n", F.explode(F.array_distinct(F.concat(F.array_compact(F.array(*three)), "o"))).alias("token"))
        return keys.withColumnRenamed("n", f"n{x}")

    pa, pb = prefix(l, "a"), prefix(r, "b")
    sized = (F.col("na") >= least * F.col("nb")) & (F.col("nb") >= least * F.col("na"))
    met = pa.join(pb, "token").where(sized).select("ida", "idb").distinct()
    both = met.join(l, "ida").join(r, "idb").withColumn("similarity", token_jaccard(F.col("ta"), F.col("tb")))
    return both.where(F.col("similarity") >= least).select("ida", "idb", "similarity")


def star(spine: DataFrame, features: Sequence[tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """spine left-joined with each table of features on its keys, one row of it a key.

    A feature that is in the result already is passed over, so names never clash; of several rows of a key
    the least in the order of its columns counts. Tables that share keys are joined one behind the other, so
    their shuffles are reused.
    """
    out = spine
    for df, keys in features:
        new = [c for c in df.columns if c not in out.columns]
        one = df.groupBy(*keys).agg(F.min(F.struct(*new)).alias("__f")) if new else df.select(*keys).distinct()
        out = out.join(one.select(*keys, *[F.col(f"__f.{c}").alias(c) for c in new]), list(keys), "left")
    return out

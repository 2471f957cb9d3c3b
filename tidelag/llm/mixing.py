"""Mixing sources to target weights by repetition rates and hash-seeded Bernoulli copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelag.llm.common import unused, words_of

#: Weights by a source's place in code point order, null last, repeating.
CYCLE = (5.0, 2.0, 1.0)
#: A target stops at so many times its source's size.
MAX_REPEATS = 3
#: 13 hexadecimal digits of an MD5 give a draw below 1 that a double holds exactly.
_DIGITS = 13


def unit_draw(key: Column, salt: str = "mix") -> Column:
    """Uniform number in [0, 1) from the MD5 of salt and key; null keys share one draw."""
    text = F.concat(F.lit(f"{salt}:"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, _DIGITS), 16, 10).cast("double") / F.lit(float(16**_DIGITS))


def source_targets(sized: DataFrame, cycle: tuple[float, ...] = CYCLE, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source (null is a source): source, source_size, target.

    sized has columns source and size. Sources, by code point and null last, weigh `cycle`, repeating,
    and share the sum of all sizes. A target above max_repeats times its source's size stops there and
    the excess is reshared by weight until none is above: that is the water level t at which
    sum(min(weight * t, cap)) equals the total, found by one pass over sources in order of
    cap / weight. A source of size 0 gets target 0. No rows in, no rows out. The windows run over one
    row per source in one task: sources are meant to be some thousands at most, not single hosts.
    """
    n = len(cycle)
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (place % n + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_repeats)
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.select(
        "source", "source_size", "weight", "cap",
        F.sum("source_size").over(everything).alias("total"),
        F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("full"),
        F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)).alias("open_weight"),
    )
    level = (F.col("total") - F.col("full")).cast("double") / F.col("open_weight")
    holds = level * F.col("weight") <= F.col("cap")
    per = per.withColumn("level", F.max(F.when(holds, level)).over(everything))
    return per.select(
        "source",
        "source_size",
        F.least(F.col("weight") * F.col("level"), F.col("cap").cast("double")).alias("target"),
    )


def with_copies(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", into: str = "__mix") -> DataFrame:
    """docs with struct column `into`: size, source_size, target, copies, taken.

    size counts words of whole texts, however long (null text: 0). A document is taken floor(rate) times plus once more where its
    hash-seeded draw is below the fraction; rate is its source's target over its source's size, at most
    MAX_REPEATS, so no document is taken more often. Equal keys get equal draws, so reruns and repeated
    rows agree. Documents of sources without words have rate 0 and are taken 0 times.
    Source sums are pre-aggregated before the shuffle; the join's small side is left to the planner.
    """
    size, name, found = (unused(docs, c) for c in ("size", "source", "found"))
    sized = docs.withColumn(size, F.size(words_of(F.col(text))).cast("long"))
    t = source_targets(sized.select(F.col(source).alias("source"), F.col(size).alias("size")))
    t = t.select(F.col("source").alias(name), F.struct("source_size", "target").alias(found))
    joined = sized.join(t, sized[source].eqNullSafe(t[name]), "left")
    of, target = F.col(found)["source_size"], F.col(found)["target"]
    rate = F.when(of > 0, target / of).otherwise(F.lit(0.0))
    copies = F.floor(rate) + (unit_draw(F.col(key)) < rate - F.floor(rate)).cast("long")
    mix = F.struct(F.col(size).alias("size"), of.alias("source_size"), target.alias("target"), copies.alias("copies"), (copies * F.col(size)).alias("taken"))
    return joined.select(*[F.col(c) for c in docs.columns], mix.alias(into))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mixed corpus: every document repeated as often as with_copies() says, columns unchanged."""
    into, copy = unused(docs, "mix"), unused(docs, "copy")
    chosen = with_copies(docs, key, source, text, into).where(F.col(into)["copies"] > 0)
    times = F.explode(F.sequence(F.lit(1), F.col(into)["copies"].cast("int")))
    return chosen.select(*[F.col(c) for c in docs.columns], times.alias(copy)).drop(copy)

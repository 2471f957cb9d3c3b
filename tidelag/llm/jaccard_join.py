"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

The order of shingles has two levels. By a bounded table of hash buckets each set is put in order, the
bucket that occurs least first, and cut to its head: a prefix that is longer than one shared shingle
needs, so that similar sets share several shingles of their heads. How often a shingle occurs in heads is
then counted exactly, and the head's own prefix by that count, rarest first, is what is joined: shingles
that no other head has never are. Pairs are filtered by the sets' sizes, by the places of the shared
shingle and by a bound on what the rest can share, and each pair that is left is verified once on the
whole sets.

Equal sets are one node of the join. Large groups of near copies would still make every pair of theirs
meet, so pairs are made in rounds that lose no link between different components: first each set meets
three pivots of each of its prefix shingles, and again with other pivots while shingles are left on which
many sets of different components meet and each round halves how many; then all those sets meet that
share a prefix shingle and are in different components yet. The round of pivots comes first at any size of
the table, so its entries meet their components once at least, however few the sets are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelag.llm.common import drop_staged, stage, unused
from tidelag.llm.components import components
from tidelag.llm.shingle_sets import mixed, parts, shingle_sets

#: Words in a shingle and least similarity in hundredths of op7.
WORDS, PERCENT = 3, 90
#: Buckets of the frequency table, as a power of 2. It is 4 bytes a bucket wherever the corpus grows to.
SKETCH_BITS = 18
_BLOCK = 4096
#: Parts of the hash range whose shares bound what two sets can have in common.
SIGNATURE = 64
#: Pivots of a shingle in a round.
PIVOTS = 3
#: Pairs left for each entry of a set in a prefix from which on another round of pivots comes first.
PAIRS_AN_ENTRY = 2
#: Ids of documents to verify are broadcast up to this many (8 bytes each), joined by a shuffle beyond.
BROADCAST_IDS = 500_000


def bucket_counts(docs: DataFrame, text: str = "text", words: int = WORDS) -> np.ndarray:
    """For every hash bucket, in how many documents' sets its shingles occur, over all documents.

    Each task sends one table, in blocks; a block's tables are added as they stream into its partition.
    """
    n = 1 << SKETCH_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, dtype=np.int64)
        for b in batches:
            for _, texts in parts(b, text):
                s, _ = shingle_sets(texts, words)
                total += np.bincount((s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=n)
        if total.any():
            yield pa.RecordBatch.from_pydict({"block": pa.array(range(n // _BLOCK), pa.int32()), "counts": pa.array([x.astype("<i4").tobytes() for x in total.reshape(-1, _BLOCK)], pa.binary())})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, x in zip(b["block"], b["counts"], strict=True):
                sums[block] = sums.get(block, 0) + np.frombuffer(x, "<i4").astype(np.int64)
        if sums:
            yield pd.DataFrame({"block": list(sums), "counts": [x.astype("<i8").tobytes() for x in sums.values()]})

    rows = docs.select(text).mapInArrow(count, "block int, counts binary").repartition("block").mapInPandas(add, "block int, counts binary").collect()
    out = np.zeros(n, dtype=np.int64)
    for r in rows:
        out[r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] = np.frombuffer(r["counts"], "<i8")
    return out


def head_length(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles in the head of a set of n: twice the prefix that one shared shingle needs, less one."""
    return np.minimum(n, 2 * (n - -(-percent * n // 100)) + 1)


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles of the head of a set of n that are joined.

    Sets of n and m that are similar enough share at least ceil(p (n + m) / (100 + p)) shingles, so their
    heads share as many less what the one that is cut more has lost. The least such number over all sizes m
    that the length filter lets through gives the prefix.
    """
    out = np.zeros(len(n), dtype=np.int64)
    sizes, place = np.unique(n, return_inverse=True)
    for k, x in enumerate(sizes.tolist()):
        if x:
            m = np.arange(-(-percent * x // 100), 100 * x // percent + 1)
            own = head_length(np.array([x]), percent)
            shared = np.minimum(own - x, head_length(m, percent) - m) - (-percent * (x + m) // (100 + percent))
            out[place == k] = own[0] - shared.min() + 1
    return out


def profiles(docs: DataFrame, counts: np.ndarray, key: str, text: str, words: int, percent: int) -> DataFrame:
    """One narrow row per document: id, n (set size), joined (prefix length), c1, c2 (hash of the set), head, signature."""
    ranks = np.unique(counts, return_inverse=True)[1].astype(np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, texts in parts(b, text):
                s, d = shingle_sets(texts, words)
                n = np.bincount(d, minlength=len(texts))
                first = np.concatenate([[0], np.cumsum(n)])
                by = np.lexsort((s, ranks[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], d))
                ordered = s[by].view(np.int64)
                sums = [np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mixed(s, seed))]) for seed in (101, 202)]
                c1, c2 = ((x[first[1:]] - x[first[:-1]]).view(np.int64) for x in sums)
                sig = np.bincount(d * SIGNATURE + ((s >> np.uint64(20)).astype(np.int64) & (SIGNATURE - 1)), minlength=len(texts) * SIGNATURE).reshape(-1, SIGNATURE).astype(np.int32)
                taken = head_length(n, percent) * (n > 0)
                head = ordered[np.arange(taken.sum()) + np.repeat(first[:-1] - np.cumsum(taken) + taken, taken)]
                lists = lambda flat, sizes: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(key).slice(rows.start, len(texts)).cast(pa.int64()), pa.array(n.astype(np.int64)), pa.array(prefix_length(n, percent)), pa.array(c1), pa.array(c2),
                        lists(head, taken), lists(sig.reshape(-1), np.full(len(texts), SIGNATURE)),
                    ],
                    ["id", "n", "joined", "c1", "c2", "head", "signature"],
                )

    return docs.select(key, text).mapInArrow(run, "id long, n long, joined long, c1 long, c2 long, head array<long>, signature array<int>")


def prefixes(sets: DataFrame) -> DataFrame:
    """token, rep, n, e (size of the head), i (place in it, rarest first) of the joined shingles that several heads have.

    Counts are exact and pre-aggregated before the shuffle; the join by shingle is one that adaptive
    execution splits where a shingle is very common.
    """
    heads = sets.select("rep", F.explode("head").alias("token"))
    several = heads.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
    own = Window.partitionBy("rep")
    placed = heads.join(several, "token").withColumns({"k": F.row_number().over(own.orderBy("c", "token")), "of": F.count("*").over(own)})
    placed = placed.join(sets.select("rep", "n", "joined", F.size("head").alias("e")), "rep")
    placed = placed.select("token", "rep", "n", "e", "joined", (F.col("e") - F.col("of") + F.col("k") - 1).alias("i"))
    return placed.where("i < joined").drop("joined")


def can_share(most: Column, a: Column, b: Column, percent: int) -> Column:
    """Whether sets of sizes a and b that share `most` shingles at most can be similar enough."""
    return (100 + percent) * most >= percent * (a + b)


def _may_match(percent: int) -> Column:
    """Length filter, and positional filter by the places i of a shared shingle in the heads, of sets a and b."""
    na, nb, ea, eb, ia, ib = (F.col(c) for c in ("na", "nb", "ea", "eb", "ia", "ib"))
    sized = 100 * F.least(na, nb) >= percent * F.greatest(na, nb)
    return sized & can_share(F.least(ea - ia, eb - ib) - F.least(ea - na, eb - nb), na, nb, percent)


def suffix_may_match(percent: int) -> Column:
    """Suffix filter: sets differ at least by what their counts of the parts of the hash range, s, do."""
    apart = F.aggregate(F.zip_with("sa", "sb", lambda p, q: F.abs(p - q)), F.lit(0), lambda t, d: t + d)
    return (100 + percent) * apart <= (100 - percent) * (F.col("na") + F.col("nb"))


def _sided(df: DataFrame, columns: tuple[str, ...], x: str) -> DataFrame:
    return df.select("token", *[F.col(c).alias(f"{c}{x}") for c in columns]) if "token" in df.columns else df.select(*[F.col(c).alias(f"{c}{x}") for c in columns])


def verify(pairs: DataFrame, docs: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose documents' whole sets are similar enough; each pair is compared once."""
    ids = stage(pairs.select(F.col("a").alias(key)).union(pairs.select(F.col("b").alias(key))).distinct(), "ids")
    few = ids.count() <= BROADCAST_IDS
    wanted = docs.select(key, text).join(F.broadcast(ids) if few else ids, key, "left_semi")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, texts in parts(b, text):
                s, d = shingle_sets(texts, words)
                cuts = np.searchsorted(d, np.arange(len(texts) + 1))
                members = pa.array([s[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(key).slice(rows.start, len(texts)).cast(pa.int64()), members], ["id", "members"])

    sets = wanted.mapInArrow(sets_of, "id long, members binary")

    @F.pandas_udf("long")
    def shared(a: pd.Series, b: pd.Series) -> pd.Series:
        read = lambda x: np.frombuffer(x, dtype=np.uint64)
        return pd.Series([len(np.intersect1d(read(x), read(y), assume_unique=True)) for x, y in zip(a, b, strict=True)], dtype="int64")

    one = lambda x: sets.select(F.col("id").alias(x), F.col("members").alias(f"m{x}"))
    both = pairs.join(one("a"), "a").join(one("b"), "b")
    size = lambda m: (F.length(m) / 8).cast("long")
    both = both.select("a", "b", size("ma").alias("na"), size("mb").alias("nb"), shared("ma", "mb").alias("common"))
    return both.where(can_share(F.col("common"), F.col("na"), F.col("nb"), percent)).select("a", "b")


def _pivot_pairs(entries: DataFrame, marks: DataFrame, seed: int, percent: int) -> DataFrame:
    """Pairs a < b of sets that may match, one of them a pivot of a shingle both have: its smallest, its largest, others by hash."""
    me = F.struct("n", "rep", "e", "i")
    by_hash = lambda k: F.min(F.struct(F.xxhash64(F.lit(seed), F.lit(k), "rep"), me.alias("p")))["p"]
    chosen = [F.min(me), F.max(me), *map(by_hash, range(PIVOTS - 2))] if seed == 0 else [*map(by_hash, range(PIVOTS))]
    pivots = entries.groupBy("token").agg(F.array(*chosen).alias("p"), F.count("*").alias("c")).where("c > 1").drop("c")
    met = _sided(entries.join(pivots, "token").withColumn("p", F.explode("p")), ("rep", "n", "e", "i", "p"), "a").select("*", *[F.col(f"pa.{c}").alias(f"{c}b") for c in ("rep", "n", "e", "i")])
    met = each_once(met.where((F.col("repa") != F.col("repb")) & _may_match(percent)))
    for x in "ab":
        met = met.join(_sided(marks, ("rep", "n", "s"), x), F.col(x) == F.col(f"rep{x}"))
    return met.where(suffix_may_match(percent)).select("a", "b")


def still_apart(found: DataFrame, joined: DataFrame | None) -> DataFrame:
    """found with g, each set's component, for the shingles on which sets of different components meet."""
    if joined is None:
        side = found.withColumn("g", F.col("rep"))
    else:
        side = found.join(joined.withColumnRenamed("node", "rep"), "rep", "left").withColumn("g", F.coalesce("component", "rep")).drop("component")
    open_tokens = side.groupBy("token").agg(F.min("g").alias("x"), F.max("g").alias("y")).where("x < y").select("token")
    return side.join(open_tokens, "token", "left_semi")


def entries_and_pairs(apart: DataFrame) -> tuple[int, int]:
    """How many entries there are, and how many pairs of entries of one shingle and different components."""
    per = apart.groupBy("token", "g").agg(F.count("*").alias("c")).groupBy("token").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("same"))
    r = per.agg(F.sum("c").alias("entries"), F.sum((F.col("c").cast("double") * F.col("c") - F.col("same")) / 2).alias("pairs")).first()
    return int(r["entries"] or 0), int(r["pairs"] or 0)


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: key, n_shingles, component_id (smallest key reachable by links).

    Two documents link when their Jaccard similarity is at least percent hundredths. Null, empty and
    blank texts have empty sets, which link with nothing. Rows that share a key are one document, which
    links wherever one of its texts does; a null key takes part in no link but its row still shows the
    component of documents with an equal set (null if there are none). Shingles are compared by 64-bit
    hashes. Ties in the order of shingles go by hash, so reruns agree. Texts of any length are read whole;
    a set's row holds its head, a fraction of the set.
    """
    counts = bucket_counts(docs, text, words)
    rows = stage(profiles(docs, counts, key, text, words, percent), "profiles")
    sets = rows.where("n > 0 AND id IS NOT NULL").groupBy("c1", "c2").agg(F.min("id").alias("rep"), F.min_by(F.struct("n", "joined", "head", "signature"), "id").alias("s"))
    sets = stage(sets.select("c1", "c2", "rep", "s.*"), "sets")
    wide, rows = rows, stage(rows.select("id", "n", "c1", "c2"), "rows")
    drop_staged(wide)
    found = stage(prefixes(sets), "prefixes")
    marks = sets.select("rep", "n", F.col("signature").alias("s"))
    joined, apart, tried, round_, last, before_pairs = None, stage(still_apart(found, None), "apart"), [], 0, False, None
    while (size := entries_and_pairs(apart))[1] and not last:
        last = before_pairs is not None and (size[1] <= PAIRS_AN_ENTRY * size[0] or 2 * size[1] > before_pairs)
        if not last:
            pairs = _pivot_pairs(apart, marks, round_, percent)
        else:
            split = apart.join(marks.select("rep", "s"), "rep")
            l, r = (_sided(split, ("rep", "n", "e", "i", "s", "g"), x) for x in "ab")
            other = (F.col("ga") != F.col("gb")) & (F.col("repa") < F.col("repb"))
            pairs = each_once(l.join(r, (l["token"] == r["token"]) & other & _may_match(percent) & suffix_may_match(percent)))
        for t in tried:
            pairs = pairs.join(t, ["a", "b"], "left_anti")
        tried.append(stage(pairs, "pairs"))
        links = stage(verify(tried[-1], docs, key, text, words, percent), "links")
        n_links = links.count()
        if n_links:
            before = [] if joined is None else [joined.select(F.col("node").alias("a"), F.col("component").alias("b"))]
            joined = stage(components(reduce(DataFrame.union, before, links)), "components")
        if n_links and not last:
            following = stage(still_apart(apart.drop("g"), joined), "apart")
            drop_staged(apart)
            apart = following
        round_, before_pairs = round_ + 1, size[1]
    for t in (found, apart, *tried):
        drop_staged(t)
    of_set = sets.select("c1", "c2", "rep")
    of_set = of_set.withColumn("g", F.col("rep")) if joined is None else of_set.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("c1", "c2", F.coalesce("component", "rep").alias("g"))
    same = rows.select("id", "n", "c1", "c2").join(of_set.select("c1", "c2", "g"), ["c1", "c2"], "left")
    return same.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("g", "id").alias("component_id"))


def each_once(met: DataFrame) -> DataFrame:
    """The pairs of columns repa and repb as a < b, each once."""
    return met.select(F.least("repa", "repb").alias("a"), F.greatest("repa", "repb").alias("b")).distinct()


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs without the documents that near_groups() links to one with a smaller key, columns unchanged.

    Rows that share a key and a text, nulls aside, are reduced to the first in the order of all their columns; rows of a
    key with other texts all stay, or all go. The keys to drop are broadcast up to BROADCAST_IDS of them and
    joined by a shuffle beyond.
    """
    groups = stage(near_groups(docs, key, text, words, percent), "groups")
    gone = groups.where(F.col("component_id") != F.col(key)).select(key).distinct()
    kept = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, key, "left_anti").select(*docs.columns)
    if not groups.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").limit(1).count():
        return kept
    nth = unused(docs, "nth")
    same = Window.partitionBy(key, F.xxhash64(text), text).orderBy(F.to_json(F.struct(*docs.columns)))
    first = kept.where(F.col(key).isNotNull()).withColumn(nth, F.row_number().over(same)).where(F.col(nth) == 1).select(*docs.columns)
    return first.union(kept.where(F.col(key).isNull()))

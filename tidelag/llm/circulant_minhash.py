"""Circulant MinHash near-dedup: signatures from two permutations, banding, exact Jaccard verification.

Shingles are hashed into the numbers below 2^32. One permutation of them breaks up the order of a set, a
second one, shifted around by k places, gives coordinate k: all coordinates come from these two. Bands
of ROWS coordinates make candidates; each candidate pair is verified once on the whole sets.

Equal sets are one node. Bands that many sets share would still make every pair of theirs meet, so
pairs are made in rounds that lose no candidate between different components: each set first meets the
smallest of each of its bands, then others by hash while each round halves what is left; at last all sets meet
that share a band, are in different components yet and have enough shingles that other components have too. With 32 bands of 5 a pair of similarity 0.8 shares
no band in 3 of a million cases; components hold as a whole where any of their links is found.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelag.llm.common import drop_staged, stage
from tidelag.llm.components import components
from tidelag.llm.jaccard_join import SIGNATURE, can_share, each_once, entries_and_pairs, still_apart, suffix_may_match, verify
from tidelag.llm.shingle_sets import mixed, parts, shingle_sets

#: Words in a shingle and least similarity in hundredths of op12.
WORDS, PERCENT = 4, 80
BANDS, ROWS = 32, 5
#: Sets of a band that each other one meets in a round.
PIVOTS = 3
#: Pairs left for each entry of a set in a band from which on another round of pivots comes first.
PAIRS_AN_ENTRY = 2


def permuted(x: np.ndarray, seed: int) -> np.ndarray:
    """A permutation of the numbers below 2^32: odd multiplications and shifts, each of which can be undone."""
    x = x ^ np.uint32(seed)
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signatures(shingles: np.ndarray, begin: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash of sets: row k has, for each set, the least of the second permutation shifted around by k.

    shingles: 64-bit hashes of all sets, one after the other; begin: where each set begins; no set is empty.
    """
    first = permuted((shingles >> np.uint64(32)).astype(np.uint32), 0x3C6EF372)
    out = np.empty((n, len(begin)), dtype=np.uint32)
    for k in range(n if len(begin) else 0):
        out[k] = np.minimum.reduceat(permuted(first - np.uint32(k), 0xA54FF53A), begin)
    return out


def band_hashes(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit hash for each set (row) and band (column); equal ones of two sets: all coordinates of the band agree."""
    rows = signature.reshape(bands, -1, signature.shape[1]).astype(np.uint64)
    h = np.broadcast_to(mixed(np.arange(bands, dtype=np.uint64), 5)[:, None], rows[:, 0].shape).copy()
    for r in range(rows.shape[1]):
        h = mixed(h ^ rows[:, r], r)
    return h.T.view(np.int64)


def profiles(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """One narrow row per document: id, n (set size), c1, c2 (hash of the set), bands, signature (set's counts by part of the hash range)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, texts in parts(b, text):
                s, d = shingle_sets(texts, words)
                n = np.bincount(d, minlength=len(texts))
                first = np.concatenate([[0], np.cumsum(n)])
                sums = [np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mixed(s, seed))]) for seed in (101, 202)]
                c1, c2 = ((x[first[1:]] - x[first[:-1]]).view(np.int64) for x in sums)
                counts = np.bincount(d * SIGNATURE + ((s >> np.uint64(20)).astype(np.int64) & (SIGNATURE - 1)), minlength=len(texts) * SIGNATURE).astype(np.int32)
                some = n > 0
                hashes = band_hashes(signatures(s, first[:-1][some]))
                lists = lambda flat, sizes: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(key).slice(rows.start, len(texts)).cast(pa.int64()), pa.array(n.astype(np.int64)), pa.array(c1), pa.array(c2),
                        lists(np.ascontiguousarray(hashes).reshape(-1), some * BANDS), lists(counts, np.full(len(texts), SIGNATURE)),
                    ],
                    ["id", "n", "c1", "c2", "bands", "signature"],
                )

    return docs.select(key, text).mapInArrow(run, "id long, n long, c1 long, c2 long, bands array<long>, signature array<int>")


def _sized(percent: int) -> Column:
    """Length filter of sets a and b."""
    return 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")


def _pivot_pairs(entries: DataFrame, seed: int, percent: int) -> DataFrame:
    """Pairs a < b, each once: the sets of a band and its smallest one, or PIVOTS of it by hash in later rounds, of other components."""
    me = F.struct("rep", "n", "g")
    by_hash = lambda k: F.min(F.struct(F.xxhash64(F.lit(seed), F.lit(k), "rep"), me.alias("p")))["p"]
    chosen = [F.min(me)] if seed == 0 else [*map(by_hash, range(PIVOTS))]
    pivots = entries.groupBy("token").agg(F.array(*chosen).alias("p"), F.count("*").alias("c")).where("c > 1").select("token", F.explode("p").alias("p"))
    met = entries.join(pivots, "token").select(F.col("rep").alias("repa"), F.col("n").alias("na"), F.col("g").alias("ga"), *[F.col(f"p.{c}").alias(f"{c}b") for c in ("rep", "n", "g")])
    return each_once(met.where((F.col("ga") != F.col("gb")) & _sized(percent)))


def _with_company(entries: DataFrame, joined: DataFrame | None, docs: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """The entries that can still be part of a link, with shared, how many of the set's shingles other components have.

    Sets of n and m share percent (n + m) / (100 + percent) shingles at least if they link, and no set shares
    more than its own number. So in large groups of copies that are each changed in places of their own those that are
    changed too much go without being compared. Shingles are counted exactly, over all sets with an entry.
    """
    ids = stage(entries.select("rep", "g").distinct(), "open")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, texts in parts(b, text):
                s, d = shingle_sets(texts, words)
                yield pa.RecordBatch.from_arrays([b.column(key).slice(rows.start, len(texts)).cast(pa.int64()).take(pa.array(d)), pa.array(s.view(np.int64))], ["rep", "shingle"])

    wanted = docs.select(key, text).join(ids.select(F.col("rep").alias(key)), key, "left_semi")
    held = stage(wanted.mapInArrow(run, "rep long, shingle long").join(ids, "rep"), "held")
    common = held.groupBy("shingle").agg(F.min("g").alias("x"), F.max("g").alias("y")).where("x < y").select("shingle")
    shared = held.join(common, "shingle", "left_semi").groupBy("rep").agg(F.count("*").alias("shared"))
    met = entries.drop("shared").join(shared, "rep")
    least = met.groupBy("token").agg(F.min("n").alias("least"))
    met = met.join(least, "token").where(can_share(F.col("shared"), F.col("n"), F.greatest("least", F.ceil(F.col("n") * percent / 100)), percent))
    out = stage(still_apart(met.drop("g", "least"), joined), "apart")
    for t in (ids, held):
        drop_staged(t)
    return out


def _all_pairs(entries: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Likely pairs a < b of sets that share a band and are in different components, each made once, at the first band that they share."""
    own = entries.groupBy("rep").agg(F.array_sort(F.collect_set("token")).alias("open"))
    sides = entries.join(own, "rep").join(sets.select("rep", "signature"), "rep")
    l, r = (sides.select(F.col("token").alias(f"token{x}"), F.col("signature").alias(f"s{x}"), *[F.col(c).alias(f"{c}{x}") for c in ("rep", "n", "shared", "g", "open")]) for x in "ab")
    once = F.element_at(F.array_intersect("opena", "openb"), 1) == F.col("tokena")
    company = can_share(F.least("shareda", "sharedb"), F.col("na"), F.col("nb"), percent)
    met = l.join(r, (F.col("tokena") == F.col("tokenb")) & (F.col("ga") != F.col("gb")) & (F.col("repa") < F.col("repb")) & _sized(percent) & company & once & suffix_may_match(percent))
    return met.select(F.col("repa").alias("a"), F.col("repb").alias("b"))


def _likely(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that pass the suffix filter."""
    for x in "ab":
        pairs = pairs.join(sets.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("signature").alias(f"s{x}")), x)
    return pairs.where(suffix_may_match(percent)).select("a", "b")


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: key, n_shingles, component_id (smallest key reachable by links).

    Two documents link when they share a band and their Jaccard similarity, of whole sets, is at least percent
    hundredths. percent should be 70 or more: below, 32 bands of 5 begin to miss links (at 0.7 1 in 300). Null, empty
    and blank texts have empty sets, which link with nothing; a text with fewer words than a shingle has its
    whole sequence as its only one. Rows that share a key are one document, which links
    wherever one of its texts does; a null key takes part in no link but its row still shows the component of
    documents with an equal set (null if there are none). Texts of any length are read whole. Ties
    among pivots go by hash and key, so reruns agree. key is cast to a 64-bit integer.
    """
    profiled = stage(profiles(docs, key, text, words), "profiles")
    sets = profiled.where("n > 0 AND id IS NOT NULL").groupBy("c1", "c2").agg(F.min("id").alias("rep"), F.min_by(F.struct("n", "bands", "signature"), "id").alias("s"))
    sets = stage(sets.select("c1", "c2", "rep", "s.*"), "sets")
    rows = stage(profiled.select("id", "n", "c1", "c2"), "rows")
    drop_staged(profiled)
    banded = sets.select("rep", "n", F.explode("bands").alias("token"))
    joined, apart, tried, round_, last, before = None, stage(still_apart(banded, None), "apart"), [], 0, False, None
    while (size := entries_and_pairs(apart))[1] and not last:
        last = round_ > 0 and (size[1] <= PAIRS_AN_ENTRY * size[0] or 2 * size[1] > before)
        for _ in range(2 * last):  # twice, as those who go leave others without company
            following = _with_company(apart, joined, docs, key, text, words, percent)
            drop_staged(apart)
            apart = following
        pairs = _all_pairs(apart, sets, percent) if last else _pivot_pairs(apart, round_, percent)
        for t in tried:
            pairs = pairs.join(t, ["a", "b"], "left_anti")
        tried.append(stage(pairs, "pairs"))
        likely = tried[-1] if last else stage(_likely(tried[-1], sets, percent), "likely")
        links = stage(verify(likely, docs, key, text, words, percent), "links")
        if not last:
            drop_staged(likely)
        if links.limit(1).count():
            known = [] if joined is None else [joined.select(F.col("node").alias("a"), F.col("component").alias("b"))]
            joined = stage(components(reduce(DataFrame.union, known, links)), "components")
        if not last:
            following = stage(still_apart(apart.drop("g"), joined), "apart")
            drop_staged(apart)
            apart = following
        round_, before = round_ + 1, size[1]
    for t in (apart, *tried):
        drop_staged(t)
    of_set = sets.select("c1", "c2", F.col("rep").alias("node"))
    of_set = of_set.withColumn("g", F.col("node")) if joined is None else of_set.join(joined, "node", "left").withColumn("g", F.coalesce("component", "node"))
    same = rows.join(of_set.select("c1", "c2", "g"), ["c1", "c2"], "left")
    return same.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("g", "id").alias("component_id"))

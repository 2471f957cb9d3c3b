"""Ranked lexical search: compressed postings in shards, merged a document at a time, best lists merged globally.

A task cuts its documents into shards of a bounded number of postings, so an index is built without
a shuffle. A shard's row of documents holds their ids in ascending order and their lengths; a row a term
holds gaps between the places of the term's documents and how often each has it, as bytes of seven bits.
A search joins the index with the items' terms, brings a shard's postings together, and in each shard
merges an item's postings by a heap of cursors into a heap of the k best documents. Lists whose bounds together
can't lift a document into that heap leave the merge and are only looked up for documents that others found,
which changes no result. Scores are 64-bit integers.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush, heapreplace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelag.llm.common import stage

#: Documents found for each item.
K = 50
#: Postings in a shard, if no single document has more.
SHARD_POSTINGS = 3_000_000
#: Items that go through a shard together.
ITEMS_A_BLOCK = 256
#: Terms of all items, repeats across items counted, up to which they are broadcast (some 100 bytes each); beyond, they are joined by a shuffle.
BROADCAST_TERMS = 500_000
#: Tasks at most that shards are dealt to.
MERGE_TASKS = 20_000
#: Saturation of tf and the share of the length in it, in hundredths of the formula below.
SCALE, TF, LENGTH, SHARE = 1_000_000_000, 1000, 20, 50
#: Terms are runs of 0-9, A-Z, a-z and everything beyond ASCII; A-Z are lower-cased.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_ROWS = 20_000


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text in order, repeats kept; none for null."""
    return text.translate(_FOLD).split() if text else []


def packed(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Lists of numbers from 0 on as binary values; list i has the numbers from cuts[i] to cuts[i + 1].

    Seven bits a byte, low ones first; the highest bit says that more follow.
    """
    v = values.astype(np.uint64)
    size = np.ones(len(v), dtype=np.int64)
    for bits in range(7, 64, 7):
        size += v >= np.uint64(1 << bits)
    begin = np.concatenate([[0], np.cumsum(size)])
    out, at, left = np.empty(int(begin[-1]), dtype=np.uint8), begin[:-1], size
    while len(v):
        more = left > 1
        out[at] = (v & np.uint64(127)).astype(np.uint8) | (more * np.uint8(128))
        v, at, left = v[more] >> np.uint64(7), at[more] + 1, left[more] - 1
    return pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(begin[cuts].astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary())


def unpacked(data: bytes) -> np.ndarray:
    """The numbers of one list of packed()."""
    b = np.frombuffer(data, dtype=np.uint8)
    last = np.flatnonzero(b < 128)
    if not len(last):
        return np.zeros(0, dtype=np.int64)
    first = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(b)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((b & 127).astype(np.int64) << (7 * place), first)


class _Shard:
    """Documents collected by a task until they are written as one shard."""

    def __init__(self) -> None:
        self.terms: defaultdict[bytes, int] = defaultdict()
        self.terms.default_factory = self.terms.__len__
        self.keys: list[int | None] = []
        self.sizes: list[int] = []
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        self.postings = 0

    def add(self, key: int | None, text: bytes | None) -> None:
        ids, tf = np.unique(np.fromiter(map(self.terms.__getitem__, terms_of(text)), dtype=np.int32), return_counts=True)
        self.keys.append(key)
        self.sizes.append(int(tf.sum()))
        self.found.append((ids, tf.astype(np.int32)))
        self.postings += len(ids)

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        """The row of documents, term null, then the terms in order; null ids come behind all others."""
        order = sorted(range(len(self.keys)), key=lambda i: (self.keys[i] is None, self.keys[i] or 0))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        ids = np.array([self.keys[i] for i in order if self.keys[i] is not None], dtype="<i8").tobytes()
        sizes = np.array([self.sizes[i] for i in order], dtype=np.int64)
        lengths = packed(sizes, np.array([0, len(sizes)]))
        yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([None], pa.string()), pa.array([int((sizes > 0).sum())]), pa.array([int(sizes.sum())]), pa.array([ids], pa.binary()), lengths], schema=_SCHEMA)
        names = sorted(self.terms)
        if not names:
            return
        place = np.empty(len(names), dtype=np.int64)
        place[[self.terms[t] for t in names]] = np.arange(len(names))
        of = place[np.concatenate([x for x, _ in self.found])]
        doc = np.repeat(rank, [len(x) for x, _ in self.found])
        tf = np.concatenate([x for _, x in self.found]).astype(np.int64)
        by = np.argsort(of * len(order) + doc, kind="stable")
        of, doc, tf = of[by], doc[by], tf[by]
        df = np.bincount(of, minlength=len(names))
        cuts = np.concatenate([[0], np.cumsum(df)])
        total = np.add.reduceat(tf, cuts[:-1])
        gaps = np.diff(doc, prepend=0)
        gaps[cuts[:-1]] = doc[cuts[:-1]]
        at = cuts[of] + np.arange(len(of))
        numbers = np.empty(2 * len(of), dtype=np.int64)
        numbers[at], numbers[at + df[of]] = gaps, tf
        for i in range(0, len(names), _ROWS):
            j = min(i + _ROWS, len(names))
            lists = packed(numbers[2 * cuts[i] : 2 * cuts[j]], 2 * (cuts[i : j + 1] - cuts[i]))
            words = pa.array([t.decode("utf-8", "replace") for t in names[i:j]], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(j - i, shard)), words, pa.array(df[i:j]), pa.array(total[i:j]), lists, pa.nulls(j - i, pa.binary())], schema=_SCHEMA)


_SCHEMA = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("n_docs", pa.int64()), ("n_terms", pa.int64()), ("postings", pa.binary()), ("sizes", pa.binary())])


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """The index of all rows of docs: shard, term, n_docs, n_terms, postings, sizes; to be stored by the caller.

    A shard has one row with a null term, of its documents: how many hold a term, all their terms, ids (in
    postings) and lengths; and a row for each term: its documents, occurrences and postings. Whole texts of
    any length are read. Rows with a null or empty text have length 0. Rows that share an id are documents of their
    own; a null id comes behind all others. key must be of an integral type. A table without rows has no shards.
    """
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        raise ValueError(f"{key} is not of an integral type")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number = _Shard(), None
        for b in batches:
            keys, texts, rows = b.column(0).to_pylist(), b.column(1), b.column(2)
            for i in range(b.num_rows):
                number = rows[i].as_py() if number is None else number  # the number of its first row names a shard
                shard.add(keys[i], texts[i].as_py())
                if shard.postings >= shard_postings:
                    yield from shard.rows(number)
                    shard, number = _Shard(), None
        if number is not None:
            yield from shard.rows(number)

    schema = "shard long, term string, n_docs long, n_terms long, postings binary, sizes binary"
    return docs.select(F.col(key).cast("long"), F.col(text).cast("binary"), F.monotonically_increasing_id()).mapInArrow(run, schema)


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """item, term: the distinct terms of each item. Rows that share a key are one item; null is a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted({t.decode("utf-8", "replace") for t in terms_of(x)}) for x in b.column(1).to_pylist()]
            of = np.repeat(np.arange(len(found)), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int64())), pa.array([t for x in found for t in x], pa.string())], ["item", "term"])

    schema = T.StructType([T.StructField("item", items.schema[key].dataType), T.StructField("term", T.StringType())])
    return items.select(F.col(key).alias("item"), F.col(text).cast("binary").alias("text")).mapInArrow(run, schema).distinct()


def saturation(sizes: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of documents of the given lengths: 100 at the mean length, 50 more for each further mean length."""
    if SHARE * int(sizes.max(initial=0)) * n_docs < 2**63:
        return 100 - SHARE + SHARE * sizes * n_docs // n_terms
    return np.array([100 - SHARE + SHARE * n * n_docs // n_terms for n in sizes.tolist()], dtype=np.int64)


def best_documents(lists: list[tuple[int, memoryview, memoryview]], k: int) -> list[tuple[int, int]]:
    """The k best (score, place) of documents with a score above 0, best first, equal scores by place.

    lists: for each term the largest share of a score in it, the places of its documents ascending, and their
    shares. Documents come by ascending place, so a later one never replaces one of an equal score.
    """
    lists = sorted(lists, key=lambda x: x[0])
    most, places, shares = ([x[i] for x in lists] for i in range(3))
    n, bounds = len(lists), [0]
    for x in most:
        bounds.append(bounds[-1] + x)
    at, first, least = [0] * n, 0, 0  # lists before `first` are only looked up
    ends = [len(p) for p in places]
    merge = [p[0] * n + i for i, p in enumerate(places) if len(p)]
    heapify(merge)
    best: list[tuple[int, int]] = []
    while merge:
        doc, i = divmod(merge[0], n)
        score = 0
        top = doc * n + n
        while True:
            p = at[i]
            score += shares[i][p]
            at[i] = p = p + 1
            if p < ends[i]:
                heapreplace(merge, places[i][p] * n + i)
            else:
                heappop(merge)
            if not merge or merge[0] >= top:
                break
            i = merge[0] - doc * n
        i = first - 1
        while i >= 0 and score + bounds[i + 1] > least:
            at[i] = p = bisect_left(places[i], doc, at[i])
            if p < ends[i] and places[i][p] == doc:
                score += shares[i][p]
            i -= 1
        if score <= least:
            continue
        if len(best) < k:
            heappush(best, (score, -doc))
        else:
            heapreplace(best, (score, -doc))
        if len(best) == k and best[0][0] > least:
            least, before = best[0][0], first
            while first < n and bounds[first + 1] <= least:
                first += 1
            if first > before:
                merge = [x for x in merge if x % n >= first]
                heapify(merge)
    return [(s, -d) for s, d in sorted(best, reverse=True)]


def search(index: DataFrame, items: DataFrame, k: int = K, item: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of each item, fewer if fewer score above 0.

    index: a stored table of build_index(); it is read four times, three of them one or two columns of it. Only postings of the items' terms are shuffled.
    A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))); a document's score sums, over the item's distinct terms,
    weight * (10^9 tf div (1000 tf + 20 m)). Equal scores go by ascending doc_id, null last. Items go in blocks,
    each a set of rows for every shard that holds one of its terms; what a task holds is bounded by a shard's
    size. Items without terms, or with terms that no document has, give no rows.
    """
    kind = items.schema[item].dataType
    totals = index.where("term IS NULL").agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("terms"), F.count("*").alias("shards")).first()
    n_docs, n_terms = totals["docs"] or 0, totals["terms"] or 0
    terms = stage(item_terms(items, item, text), "terms")
    small = F.broadcast if terms.count() <= BROADCAST_TERMS else lambda df: df
    blocks = max(1, -(-items.count() // ITEMS_A_BLOCK))
    terms = terms.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    wanted = terms.groupBy("term", "block").agg(F.collect_list(F.struct("item")).alias("items"))
    df = index.where("term IS NOT NULL").join(small(wanted.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.sum("n_docs").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long").alias("weight")
    weighted = wanted.join(df, "term").select("term", "block", "items", weight).where("weight > 0")
    lists = index.where("term IS NOT NULL").select("shard", "term", "n_docs", "postings").join(small(weighted), "term").drop("term")
    heads = index.where("term IS NULL").select("shard", F.col("postings").alias("ids"), "sizes")
    of = lists.select("shard", "block").distinct().join(heads, "shard")
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    own = T.ArrayType(T.StructType([T.StructField("item", kind)]))
    rows = lists.select("shard", "block", "items", "weight", "n_docs", "postings", none("ids", "binary"), none("sizes", "binary"))
    rows = rows.union(of.select("shard", "block", none("items", own), none("weight", "long"), none("n_docs", "long"), none("postings", "binary"), "ids", "sizes"))
    schema = T.StructType([T.StructField("item", kind), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        head = part[part["items"].isna()].iloc[0]
        ids, sizes = np.frombuffer(head["ids"], "<i8"), unpacked(head["sizes"])
        m = saturation(sizes, n_docs, n_terms)
        of_item = defaultdict(list)
        for r in part[part["items"].notna()].itertuples(index=False):
            numbers = unpacked(r.postings)
            df = int(r.n_docs)
            places, tf = np.cumsum(numbers[:df]), numbers[df:]
            shares = int(r.weight) * (SCALE * tf // (TF * tf + LENGTH * m[places]))
            entry = (int(shares.max()), memoryview(places), memoryview(shares))
            for x in r.items:
                of_item[x["item"]].append(entry)
        out = [(x, s, d) for x, entries in of_item.items() for s, d in best_documents(entries, k)]
        return pd.DataFrame({"item": pd.Series([x[0] for x in out], dtype=object), "doc_id": pd.array([int(ids[d]) if d < len(ids) else None for _, _, d in out], dtype="Int64"), "score": [s for _, s, _ in out]})

    tasks = min(MERGE_TASKS, max(1, totals["shards"] * blocks))  # a shard is few bytes and much work, so sizes don't tell how many tasks it takes
    best = rows.repartition(tasks, "shard", "block").groupBy("shard", "block").applyInPandas(run, schema)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("item").alias("item_id"), "rank", "doc_id", "score")

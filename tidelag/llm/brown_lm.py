"""Class-based bigram model: words fall into classes by exchange clustering.

P(word | class before) = P(class | class before) * P(word | class). Clustering has two steps. Units, the
TOP_WORDS most frequent words and the spelling classes of all others, a hash of their last letters and
length, are exchanged one by one on the table of neighbouring units. Then every one of the SENT_WORDS most
frequent words is exchanged by itself: how often it stands before and after each class is counted over all
training documents, and it moves to the class that raises the likelihood most. Rarer and unknown words keep
the class of their spelling, so every word has one. All counts cover all training documents.
Smoothing: class bigrams are interpolated with class frequencies; in a class, each known word gives up a
discount, and an unknown word gets what they gave up. Every document ends with an end token, a class of
its own, which also stands before its first word.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelag.llm.common import stage

TOP_WORDS = 256
SPELLINGS = 255
#: Classes grow with the cube root of the vocabulary between these.
CLASSES = (32, 256)
#: Passes over all units; none moves more than once in a pass.
PASSES = 8
DISCOUNT = 0.75
#: Frequent words, whose counts and classes tasks get; every other word's count comes by a join.
SENT_WORDS = 300_000
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 500_000
#: Words in one batch that it hands on, and words whose contexts are added up together.
HANDED_WORDS = 50_000
CONTEXT_WORDS = 2048
#: Contexts that a task holds before it adds them up and hands them on.
HELD_CONTEXTS = 2_000_000
#: Numbers that are gathered at once to add up what words gain.
GATHERED = 500_000
#: Documents whose ids a task works on at once.
SLICE = 1000
END = TOP_WORDS + SPELLINGS
UNITS = END + 1
_BLOCK = 8192
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def held_out(key: Column) -> Column:
    """Whether a document is kept from training: crc32 of its key's text modulo 7 is 2; a null key is not."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8, A to Z lower-cased; bytes.split() parts at the six gap characters alone."""
    return text.encode("utf-8", "replace").translate(_LOWER).split() if text else []


def spelling(word: bytes) -> int:
    """The spelling unit of a word: its last bytes and whether it is short, middling or long."""
    return TOP_WORDS + zlib.crc32(word[-4:], min(len(word), 12) // 4) % SPELLINGS


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """word, c: occurrences of every word; counted in tasks, then pre-aggregated and summed."""

    def handed(seen: Counter) -> Iterator[pa.RecordBatch]:
        words, n = list(seen), np.fromiter(seen.values(), dtype=np.int64, count=len(seen))
        for i in range(0, len(words), HANDED_WORDS):
            part = [w.decode("utf-8", "replace") for w in words[i : i + HANDED_WORDS]]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array(n[i : i + HANDED_WORDS])], ["word", "c"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(words_of(t))
                if len(seen) > HELD_WORDS:
                    yield from handed(seen)
                    seen = Counter()
        yield from handed(seen)

    return docs.select(text).mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass(frozen=True)
class Frequent:
    """The words whose counts all tasks get, most frequent first; the first TOP_WORDS are units of their own.

    A word's id is its place; any other word's is len(place) + its spelling class, the end's the last.
    """

    place: dict[bytes, int]
    count: np.ndarray

    @property
    def end(self) -> int:
        return len(self.place) + SPELLINGS

    def units(self) -> np.ndarray:
        """The unit of each id."""
        own = [i if i < TOP_WORDS else spelling(w) for w, i in self.place.items()]
        return np.array([*own, *range(TOP_WORDS, END + 1)], dtype=np.int64)

    def ids(self, words: list[bytes]) -> np.ndarray:
        at = np.fromiter(map(self.place.get, words, repeat(-1)), dtype=np.int32, count=len(words))
        if len(rare := np.flatnonzero(at < 0)):
            at[rare] = [len(self.place) + spelling(words[i]) - TOP_WORDS for i in rare.tolist()]
        return at


def frequent_words(counts: DataFrame, most: int = SENT_WORDS) -> Frequent:
    """All words above the lowest count that at most `most` words reach, found on a histogram of counts.

    A few hundred buckets and then `most` rows come to the driver, however many tasks there are.
    """
    buckets = counts.groupBy(F.floor(F.log2("c") * 8).alias("b")).agg(F.count("*").alias("n"), F.min("c").alias("least")).orderBy(F.desc("b")).collect()
    total, least = 0, None
    for r in buckets:
        total += r["n"]
        if total > most:
            break
        least = r["least"]
    rows = [] if least is None else sorted((-r["c"], r["word"].encode("utf-8")) for r in counts.where(F.col("c") >= least).collect())
    return Frequent({w: i for i, (_, w) in enumerate(rows)}, np.array([-c for c, _ in rows], dtype=np.int64))


def encoded(docs: DataFrame, key: str, text: str, frequent) -> DataFrame:
    """rid, key, learned, ids, words of every row of docs: its words' ids, and those words that are not frequent, in order.

    frequent is the broadcast Frequent. rid numbers the rows; learned says whether the model learns from them.
    """
    shape = "rid long, key long, learned boolean, ids array<int>, words array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = frequent.value
        rid = TaskContext.get().partitionId() << 40
        for b in _slices(batches):
            ids, words = [], []
            for t in b.column(2).to_pylist():
                w = words_of(t)
                at = f.ids(w)
                ids.append(at)
                words.append([w[i].decode("utf-8", "replace") for i in np.flatnonzero(at >= len(f.place)).tolist()])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]), pa.int32()), pa.array(np.concatenate([np.zeros(0, dtype=np.int32), *ids])))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rid, rid + len(b), dtype=np.int64)), b.column(0).cast(pa.int64()), b.column(1), lists, pa.array(words, pa.list_(pa.string()))], shape.replace(",", "").split()[::2])
            rid += len(b)

    return docs.select(key, ~held_out(F.col(key)), text).mapInArrow(run, shape)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of SLICE rows, so a task holds the ids of few documents at once."""
    for b in batches:
        for i in range(0, len(b), SLICE):
            yield b.slice(i, SLICE)


def _sequence(lists: pa.ListArray, end: int) -> np.ndarray:
    """The ids of a batch's documents in one row, an end before the first and behind each."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    ids, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
    return np.concatenate([[end], np.insert(ids, ends, end)]).astype(np.int64)


def neighbours(coded: DataFrame, of, end: int, n: int) -> np.ndarray:
    """n x n counts of neighbours over all rows of coded that the model learns from; `of`, broadcast, maps ids to 0 .. n - 1.

    Each task sends one table in blocks, which are added as they stream into a block's partition.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n * n, dtype=np.int64)
        for b in _slices(batches):
            x = of.value[_sequence(b.column(0), end)]
            total += np.bincount(x[:-1] * n + x[1:], minlength=n * n)
        if total.any():
            cuts = range(0, n * n, _BLOCK)
            yield pa.RecordBatch.from_pydict({"block": pa.array(range(len(cuts)), pa.int32()), "n": pa.array([total[i : i + _BLOCK].tobytes() for i in cuts], pa.binary())})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, x in zip(b["block"], b["n"], strict=True):
                sums[block] = sums.get(block, 0) + np.frombuffer(x, dtype=np.int64)
        if sums:
            yield pd.DataFrame({"block": list(sums), "n": [x.tobytes() for x in sums.values()]})

    out = np.zeros(n * n, dtype=np.int64)
    for r in coded.where("learned").select("ids").mapInArrow(count, "block int, n binary").repartition("block").mapInPandas(add, "block int, n binary").collect():
        x = np.frombuffer(r["n"], dtype=np.int64)
        out[r["block"] * _BLOCK : r["block"] * _BLOCK + len(x)] = x
    return out.reshape(n, n)


def _h(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def gains(g: np.ndarray, to: np.ndarray, fro: np.ndarray, own: float, out: float, into: float) -> np.ndarray:
    """What each class's part of the bigram likelihood gains if a word joins it.

    g has the counts of neighbouring classes without the word; to and fro its counts before and after each
    class, without those with itself, which are own; out and into their sums.
    """
    d = np.arange(len(g))
    h = _h(g)
    row = (_h(g + to[None, :]) - h).sum(1)
    col = (_h(g + fro[:, None]) - h).sum(0)
    diag = _h(g[d, d] + to + fro + own) - _h(g[d, d] + to) - _h(g[d, d] + fro) + h[d, d]
    rows, cols = g.sum(1), g.sum(0)
    return row + col + diag - (_h(rows + out) - _h(rows)) - (_h(cols + into) - _h(cols))


def exchange(n: np.ndarray, classes: int, passes: int = PASSES) -> np.ndarray:
    """Class of each unit: units move, one at a time, to the class that raises the bigram likelihood most.

    n counts neighbouring units; the last unit, the end, keeps the last class to itself. Starts from
    units dealt out by frequency; stops when a pass moves none. Ties go to the lowest class.
    """
    size, k = len(n), classes - 1
    freq = n.sum(0) + n.sum(1)
    place = np.empty(size, dtype=np.int64)
    order = np.argsort(-freq[: size - 1], kind="stable")
    place[order] = np.arange(size - 1) % k
    place[size - 1] = k
    onto = np.zeros((size, classes))
    onto[np.arange(size), place] = 1
    left, right = n @ onto, (n.T @ onto)  # unit before class, and class before unit
    g = (onto.T @ n @ onto).astype(float)
    for _ in range(passes):
        moved = 0
        for w in order.tolist():
            if not freq[w]:
                continue
            a, own = place[w], n[w, w]
            to, fro = left[w].copy(), right[w].copy()  # counts w -> class, class -> w
            to[a] -= own
            fro[a] -= own
            g[a] -= to
            g[:, a] -= fro
            g[a, a] -= own
            gain = gains(g, to, fro, own, to.sum() + own, fro.sum() + own)
            gain[k] = -np.inf
            c = int(np.argmax(gain))
            if gain[c] <= gain[a] + 1e-9:
                c = a
            g[c] += to
            g[:, c] += fro
            g[c, c] += own
            if c != a:
                moved += 1
                place[w] = c
                left[:, a] -= n[:, w]
                left[:, c] += n[:, w]
                right[:, a] -= n[w]
                right[:, c] += n[w]
        if not moved:
            break
    return place


def _joined(g: np.ndarray, h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each word and class, what the class's row of g gains if the word's counts are added to it.

    Only counts above 0 are looked at, in runs of words; a run takes the logarithms of equal ones in a column once.
    """
    k, most = len(g), int(counts.max(initial=0)) + 1
    out = np.zeros((len(counts), k))
    w, j = np.nonzero(counts)
    pairs, ends = j * most + counts[w, j], np.searchsorted(w, np.arange(len(counts) + 1))
    for lo, hi in _runs(ends, max(1, GATHERED // k)):
        own = lo + np.flatnonzero(np.diff(ends[lo : hi + 1]))
        if len(own):
            found, place = np.unique(pairs[ends[lo] : ends[hi]], return_inverse=True)
            of = found // most
            gain = np.ascontiguousarray((_h(g[:, of] + found % most) - h[:, of]).T)
            out[own] = np.add.reduceat(gain[place], ends[own] - ends[lo])
    return out


def _runs(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs lo, hi of rows that have at most `most` entries together, or are one row; row i has ends[i] to ends[i + 1]."""
    lo, n = 0, len(ends) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + most, side="right")) - 1)
        yield lo, hi
        lo = hi


def best_classes(table: np.ndarray, old: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The class that each word moves to by gains(), all words on one state; ties go to the lowest, none leaves for no gain.

    A row of table has a word's counts before each class, after each class and before itself; old has the
    words' classes and g the counts of neighbouring classes with them. Taking a word out of its class
    changes one row and one column of g, so the rest is worked out for all words at once.
    """
    k, i = len(g), np.arange(len(old))
    to, fro, own = table[:, :k].copy(), table[:, k : 2 * k].copy(), table[:, -1]
    to[i, old] -= own
    fro[i, old] -= own
    d, total, out, into = np.arange(k), own + to[i, old] + fro[i, old], to.sum(1) + own, fro.sum(1) + own
    diag = np.tile(g[d, d], (len(old), 1))
    diag[i, old] -= total

    def side(g: np.ndarray, to: np.ndarray, fro: np.ndarray, out: np.ndarray) -> np.ndarray:
        gain = _joined(g, _h(g), to)
        entry, there = g[:, old].T, to[i, old][:, None]  # what other classes have before the word's own
        gain += _h(entry - fro + there) - _h(entry - fro) - _h(entry + there) + _h(entry)
        left = g[old] - to  # the word's own class without it
        left[i, old] = diag[i, old]
        gain[i, old] = (_h(left + to) - _h(left)).sum(1)
        sums = g.sum(1) - fro
        sums[i, old] -= out
        return gain - _h(sums + out[:, None]) + _h(sums)

    gain = side(g, to, fro, out) + side(g.T, fro, to, into)
    gain += _h(diag + to + fro + own[:, None]) - _h(diag + to) - _h(diag + fro) + _h(diag)
    gain[:, k - 1] = -np.inf
    best = gain.argmax(1)
    return np.where((out + into > 0) & (gain[i, best] > gain[i, old] + 1e-9), best, old)


def exchange_words(coded: DataFrame, frequent, class_of, g: np.ndarray) -> np.ndarray:
    """The class that each frequent word moves to, given everybody's class; ties go to the lowest, none leaves for no gain.

    class_of, broadcast, has the class of each id, and g the counts of neighbouring classes under it. The
    words' contexts are counted in tasks as sparse pairs, added up in blocks of CONTEXT_WORDS words, and
    each block's words are moved where they are: all at once, so on one state of the classes. What comes
    to the driver, from all blocks in one job, is a number for each frequent word.
    """
    classes, words, end = len(g), len(frequent.value.place), frequent.value.end
    wide = 2 * classes + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held, size, small = class_of.value, [], 0, np.min_scalar_type(words * wide)

        def handed() -> Iterator[pa.RecordBatch]:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            cuts = np.searchsorted(keys, np.arange(0, words + CONTEXT_WORDS, CONTEXT_WORDS) * wide)
            for i, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                if lo < hi:
                    yield pa.RecordBatch.from_pydict({"block": pa.array([i], pa.int32()), "keys": pa.array([(keys[lo:hi] - i * CONTEXT_WORDS * wide).astype("<i4").tobytes()], pa.binary()), "n": pa.array([n[lo:hi].astype("<i4").tobytes()], pa.binary())})

        for b in _slices(batches):
            x = _sequence(b.column(0), end)
            c, at = of[x], np.flatnonzero(x < words)
            w = x[at] * wide
            held += [k.astype(small) for k in (w + c[at + 1], w + classes + c[at - 1], w[x[at] == x[at + 1]] + 2 * classes)]
            size += 2 * len(at)
            if size > HELD_CONTEXTS:
                yield from handed()
                held, size = [], 0
        if held:
            yield from handed()

    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, keys, n in zip(b["block"], b["keys"], b["n"], strict=True):
                found = sums.setdefault(block, np.zeros(CONTEXT_WORDS * wide, dtype=np.int64))
                found[np.frombuffer(keys, "<i4")] += np.frombuffer(n, "<i4")  # what is handed on at once fits; its sum need not
        for block, found in sums.items():
            old = class_of.value[block * CONTEXT_WORDS : min(words, (block + 1) * CONTEXT_WORDS)]
            new = best_classes(found.reshape(CONTEXT_WORDS, wide)[: len(old)], old, g)
            yield pd.DataFrame({"block": [block], "classes": [new.astype("<i4").tobytes()]})

    out = class_of.value.copy()
    for r in coded.where("learned").select("ids").mapInArrow(count, "block int, keys binary, n binary").repartition(max(1, -(-words // CONTEXT_WORDS)), "block").mapInPandas(move, "block int, classes binary").collect():
        x = np.frombuffer(r["classes"], "<i4")
        out[r["block"] * CONTEXT_WORDS : r["block"] * CONTEXT_WORDS + len(x)] = x
    return out


@dataclass(frozen=True)
class ClassModel:
    """Each id's class, log10 class bigrams, tokens and distinct words of classes."""

    classes: np.ndarray
    bigram: np.ndarray
    sizes: np.ndarray
    types: np.ndarray

    def share(self) -> np.ndarray:
        """log10 of what a known word's discounted count in a class is multiplied by."""
        return -np.log10(np.maximum(self.sizes, 1))

    def unknown(self) -> np.ndarray:
        """log10 probability of an unknown word in a class; a class without words is all unknown."""
        return np.log10(np.where(self.sizes > 0, DISCOUNT * self.types / np.maximum(self.sizes, 1), 1.0))


def class_bigrams(g: np.ndarray) -> np.ndarray:
    """log10 P(class | class before) from counts: those less a discount, what is spared by class frequency plus one."""
    base = (g.sum(0) + 1) / (g.sum() + len(g))
    total = g.sum(1, keepdims=True)
    cut = np.minimum(g, DISCOUNT)
    spared = np.where(total > 0, cut.sum(1, keepdims=True) / np.maximum(total, 1), 1.0)
    p = np.where(total > 0, (g - cut) / np.maximum(total, 1), 0.0) + spared * base[None, :]
    return np.log10(p)


def train(counts: DataFrame, coded: DataFrame, frequent, types: int) -> ClassModel:
    """Clusters and class statistics from the staged word counts and encoded documents."""
    context = coded.sparkSession.sparkContext
    classes = int(np.clip(2 ** round(np.log2(max(types, 1)) / 3), *CLASSES))
    units, end = frequent.value.units(), frequent.value.end
    n = neighbours(coded, context.broadcast(units), end, UNITS)
    place = exchange(n, classes)
    onto = np.zeros((UNITS, classes))
    onto[np.arange(UNITS), place] = 1
    of = exchange_words(coded, frequent, context.broadcast(place[units]), onto.T @ n @ onto)
    sent = context.broadcast(of)
    bigram = class_bigrams(neighbours(coded, sent, end, classes))

    def stats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size, kinds = np.zeros(classes, dtype=np.int64), np.zeros(classes, dtype=np.int64)
        for b in batches:
            c = sent.value[frequent.value.ids([x.encode("utf-8") for x in b["word"]])]
            size += np.bincount(c, weights=b["c"].to_numpy(), minlength=classes).astype(np.int64)
            kinds += np.bincount(c, minlength=classes)
        yield pd.DataFrame({"k": range(classes), "size": size, "types": kinds})

    rows = counts.mapInPandas(stats, "k int, size long, types long").groupBy("k").agg(F.sum("size").alias("size"), F.sum("types").alias("types")).collect()
    size, kinds = np.zeros(classes), np.zeros(classes)
    for r in rows:
        size[r["k"]], kinds[r["k"]] = r["size"], r["types"]
    return ClassModel(of, bigram, size, kinds)


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Trains on the documents that held_out() leaves and scores all, whole texts of any length; null counts as empty, one
    end token. base_score is the add-one unigram's. Texts are split once and kept as ids in the shared
    folder. The counts of SENT_WORDS frequent words go to all tasks; the other words are joined with the
    counts by word and added up. An unknown word's probability is split among the classes, so the events of
    a context add up to one at most. Without training documents every known count is 0. Ties of counts go
    by word, so reruns agree; repeated rows each count, and get equal scores.
    """
    learned = docs.where(~held_out(F.col(key)))
    counts = stage(word_counts(learned, text), "counts")
    ends = learned.count()
    r = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    total, types = r["n"] + ends, r["v"] + (1 if ends else 0)
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_words(counts))
    coded = stage(encoded(docs, key, text, frequent), "coded")
    model = train(counts, coded, frequent, types)
    frequent_counts = docs.sparkSession.sparkContext.broadcast(frequent.value.count)  # without the words, which only encoded() looks up
    shape = "rid long, key long, n_tokens long, n_known long, base double, own double, classes array<int>, words array<string>"

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, share = frequent_counts.value, model.share()
        n, end = len(f), len(f) + SPELLINGS
        own_logs, base_logs = np.log10(f - DISCOUNT) + share[model.classes[:n]], np.log10(f + 1.0)
        for b in _slices(batches):
            lists = b.column(2)
            x = _sequence(lists, end)
            sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(b)), sizes + 1)
            c = model.classes[x]
            moves = np.bincount(doc, model.bigram[c[:-1], c[1:]], minlength=len(b))
            seen, w = x[1:] < n, x[1:]
            sums = lambda logs: np.bincount(doc[seen], logs[w[seen]], minlength=len(b))  # noqa: B023, E731
            rare = (w >= n) & (w != end)
            cuts = np.concatenate([[0], np.cumsum(np.bincount(doc[rare], minlength=len(b)))])
            arrays = [
                b.column(0), b.column(1), pa.array((sizes + 1).astype(np.int64)), pa.array(np.bincount(doc[seen], minlength=len(b)).astype(np.int64)), pa.array(sums(base_logs).astype(float)), pa.array((moves + sums(own_logs)).astype(float)),
                pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(c[1:][rare].astype(np.int32))), b.column(3),
            ]
            yield pa.RecordBatch.from_arrays(arrays, shape.replace(",", "").split()[::2])

    scored = stage(coded.select("rid", "key", "ids", "words").mapInArrow(part, shape), "parts")
    share, unknown = (F.array(*[F.lit(float(v)) for v in x]) for x in (model.share(), model.unknown()))
    rest = scored.select("rid", F.explode(F.arrays_zip("words", "classes")).alias("w")).select("rid", F.col("w.words").alias("word"), F.col("w.classes").alias("k")).join(counts, "word", "left")
    known = F.col("c").isNotNull()
    rest = rest.groupBy("rid").agg(
        F.count("c").alias("more_known"),
        F.sum(F.when(known, F.log10(F.col("c") + 1.0)).otherwise(0.0)).alias("more_base"),
        F.sum(F.when(known, F.log10(F.col("c") - DISCOUNT) + F.get(share, "k")).otherwise(F.get(unknown, "k"))).alias("more_own"),
    )
    both = scored.drop("classes", "words").join(rest, "rid", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return both.select(
        F.col("key").alias(key),
        held_out(F.col("key")).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + zero("more_known") + (1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("more_base") + float(np.log10(ends + 1)) - F.col("n_tokens") * float(np.log10(total + types + 1))).alias("base_score"),
        (F.col("own") + zero("more_own")).alias("score"),
    )

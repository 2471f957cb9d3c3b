"""Vector code compression: product codes from codebooks refined by rounds of nearest assignment.

Components become integers, vectors are cut into equal parts, and each part has a codebook. A round
broadcasts one kd-tree for each codebook; every task finds its parts' nearest entries by branch and
bound and adds up the parts of each entry as integers, so sums over tasks are exact in any order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelag.llm.common import stage, unused

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: A component x counts as floor(SCALE * x).
SCALE = 1024
#: Entries in a leaf of a tree.
LEAF = 16
#: Vectors worked on at once.
_BLOCK = 8192


@dataclass
class Tree:
    """A kd-tree over the rows of an integer codebook, split at the median of the widest dimension.

    Nodes are (low, high, left, right, members): the box around the node's entries, and either two
    children or the entries' numbers.
    """

    entries: np.ndarray
    nodes: list[tuple] = field(default_factory=list)

    def __post_init__(self) -> None:
        if len(self.entries):
            self._grow(np.arange(len(self.entries)))

    def _grow(self, members: np.ndarray) -> int:
        e = self.entries[members]
        low, high = e.min(axis=0), e.max(axis=0)
        me = len(self.nodes)
        self.nodes.append(())
        if len(members) <= LEAF or (low == high).all():
            self.nodes[me] = (low, high, -1, -1, members)
        else:
            axis = int((high - low).argmax())
            order = members[np.argsort(e[:, axis], kind="stable")]
            half = len(order) // 2
            self.nodes[me] = (low, high, self._grow(np.sort(order[:half])), self._grow(np.sort(order[half:])), None)
        return me

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of x the nearest entry's number and its squared distance; ties go to the lower number.

        All rows go down the tree together, each to the nearer child first. A child whose box is as far
        as the best so far is still visited: an entry there may tie with a lower number.
        """
        largest = max(int(np.abs(self.entries).max()), int(np.abs(x).max(initial=0)))
        if 4 * x.shape[1] * largest**2 < 2**53:  # then doubles hold every sum below exactly, and multiply faster
            x = x.astype(np.float64)
        best = np.full(len(x), np.iinfo(np.int64).max, dtype=x.dtype)
        found = np.full(len(x), len(self.entries), dtype=np.int64)
        self._visit(0, np.arange(len(x)), x, (x * x).sum(axis=1), best, found)
        return found, best.astype(np.int64)

    def _bound(self, node: int, x: np.ndarray) -> np.ndarray:
        low, high = self.nodes[node][:2]
        out = np.maximum(np.maximum(low - x, x - high), 0)
        return (out * out).sum(axis=1)

    def _visit(self, node: int, rows: np.ndarray, x: np.ndarray, norms: np.ndarray, best: np.ndarray, found: np.ndarray) -> None:
        if not len(rows):
            return
        _, _, left, right, members = self.nodes[node]
        if members is not None:
            e = self.entries[members].astype(x.dtype)
            far = norms[rows][:, None] - 2 * (x[rows] @ e.T) + (e * e).sum(axis=1)
            k = far.argmin(axis=1)  # members ascend, so the first least one has the lowest number
            d, e = far[np.arange(len(rows)), k], members[k]
            better = (d < best[rows]) | ((d == best[rows]) & (e < found[rows]))
            best[rows[better]], found[rows[better]] = d[better], e[better]
            return
        at = x[rows]
        to_left, to_right = self._bound(left, at), self._bound(right, at)
        near = to_left <= to_right
        self._visit(left, rows[near], x, norms, best, found)
        self._visit(right, rows[~near], x, norms, best, found)
        self._visit(right, rows[near & (to_right <= best[rows])], x, norms, best, found)
        self._visit(left, rows[~near & (to_left <= best[rows])], x, norms, best, found)


@dataclass
class Codebooks:
    """Integer codebooks of equal length, one for each part: parts of shape (entries, width)."""

    parts: list[np.ndarray]

    @property
    def dims(self) -> int:
        return sum(p.shape[1] for p in self.parts)

    def sha256(self) -> str:
        """Of all entries' components by part, entry and position, decimal and comma-joined."""
        return hashlib.sha256(",".join(str(v) for p in self.parts for v in p.reshape(-1).tolist()).encode()).hexdigest()


def largest_component(dims: int) -> int:
    """The largest size of an integer component at which no distance of whole vectors leaves 64 bits."""
    return int((2**62 // max(dims, 1)) ** 0.5) // 2


def _vectors(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows that are kept, and their integer components.

    Left out are null vectors, null and non-finite components, components beyond largest_component(), and
    lengths other than dims.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.asarray(column.value_lengths().fill_null(-1))
    wanted = np.flatnonzero(size == dims)
    flat = column.take(pa.array(wanted)).flatten()
    x = np.asarray(flat.cast(pa.float64()).fill_null(np.nan)).reshape(-1, dims)
    with np.errstate(over="ignore"):
        scaled = np.floor(x * SCALE)
    fine = (np.isfinite(scaled) & (np.abs(scaled) <= largest_component(dims))).all(axis=1)
    return wanted[fine], scaled[fine].astype(np.int64)


def _batches(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return (b.slice(i, _BLOCK) for i in range(0, b.num_rows, _BLOCK))


def kept(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vectors without those that are null or hold a null or non-finite component."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.col(vector).isNotNull() & fine)


def seeds(vectors: DataFrame, entries: int = ENTRIES, key: str = "vec_id", vector: str = "embedding") -> list:
    """The kept vectors of the `entries` smallest keys, ascending: a list bounded by entries; no row has a null key.

    Among rows that share a key the vector that is least in the order of its components counts.
    Tasks keep their own smallest keys; only if rows share keys are the distinct keys shuffled.
    """
    keyed = kept(vectors, vector).where(F.col(key).isNotNull())
    first = [r[0] for r in keyed.select(key).orderBy(key).limit(entries).collect()]
    if len(set(first)) < len(first) == entries:
        first = [r[0] for r in keyed.select(key).distinct().orderBy(key).limit(entries).collect()]
    if not first:
        return []
    rows = keyed.where(F.col(key).isin(sorted(set(first)))).groupBy(key).agg(F.min(vector).alias("v"))
    return [r["v"] for r in rows.orderBy(key).collect()]


def first_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, key: str = "vec_id", vector: str = "embedding") -> Codebooks | None:
    """Codebooks that start as the parts of the vectors of the smallest keys; None without any kept vector.

    The smallest key's vector gives the number of components; vectors of another length have no code.
    Raises ValueError if that number can't be cut into equal parts.
    """
    found = seeds(vectors, entries, key, vector)
    if not found:
        return None
    dims = len(found[0])
    if not dims or dims % parts:
        raise ValueError(f"{dims} components can't be cut into {parts} equal parts")
    _, x = _vectors(pa.array([list(map(float, v)) for v in found], pa.list_(pa.float64())), dims)
    return Codebooks(np.split(x, parts, axis=1)) if len(x) else None


def refined(vectors: DataFrame, books: Codebooks, vector: str = "embedding") -> Codebooks:
    """Codebooks after one round: every entry is the componentwise floor of the mean of the parts nearest to it.

    Entries nearest to none stay. A task holds one table of sums, as large as the codebooks; tables are
    added up by part and entry, and as many rows as there are entries come back.
    """
    spark, dims = vectors.sparkSession, books.dims
    width = dims // len(books.parts)
    trees = spark.sparkContext.broadcast([Tree(p) for p in books.parts])
    names = [f"s{i}" for i in range(width)]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(t.entries), width + 1), dtype=np.int64) for t in trees.value]
        for whole in batches:
            for b in _batches(whole):
                _, x = _vectors(b.column(0), dims)
                for k, tree in enumerate(trees.value):
                    part = x[:, k * width : (k + 1) * width]
                    near, _ = tree.nearest(part)
                    order = np.argsort(near, kind="stable")
                    used, begin = np.unique(near[order], return_index=True)
                    if len(used):
                        sums[k][used, 0] += np.diff(np.append(begin, len(order)))
                        sums[k][used, 1:] += np.add.reduceat(part[order], begin, axis=0)
        for k, s in enumerate(sums):
            used = np.flatnonzero(s[:, 0])
            if len(used):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), k, np.int32)), pa.array(used.astype(np.int32)), *[pa.array(s[used, i]) for i in range(width + 1)]], ["part", "entry", "c", *names])

    schema = ", ".join(["part int", "entry int", "c long", *[f"{n} long" for n in names]])
    totals = vectors.select(vector).mapInArrow(add, schema).groupBy("part", "entry").agg(F.sum("c").alias("c"), *[F.sum(n).alias(n) for n in names])
    out = [p.copy() for p in books.parts]
    for r in totals.collect():  # a row for each entry at most
        out[r["part"]][r["entry"]] = [r[n] // r["c"] for n in names]
    trees.destroy()
    return Codebooks(out)


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, key: str = "vec_id", vector: str = "embedding") -> Codebooks | None:
    """first_codebooks() refined `rounds` times over all vectors; None without any kept vector."""
    books = first_codebooks(vectors, parts, entries, key, vector)
    for _ in range(rounds if books else 0):
        books = refined(vectors, books, vector)
    return books


def with_codes(vectors: DataFrame, books: Codebooks | None, vector: str = "embedding", into: str = "__code") -> DataFrame:
    """Rows of vectors that are kept, with struct column `into`: code (two hex digits a part), error.

    error is the squared distance of the vector to the entries of its code. Null vectors and those with null or
    non-finite components are left out. Code and error are null where the vector has another number
    of components than the codebooks or one beyond largest_component(). Repeated rows stay and get equal codes.
    Raises ValueError if vectors already has a column `into`, or if codebooks hold over 256 entries.
    """
    if into.lower() in {c.lower() for c in vectors.columns}:
        raise ValueError(f"the table already has a column {into}")
    rows = kept(vectors, vector)
    if books is None:
        return rows.withColumn(into, F.lit(None).cast("struct<code: string, error: bigint>"))
    if max(len(p) for p in books.parts) > 256:
        raise ValueError("a code has two hex digits for each part, so 256 entries at most")
    return rows.withColumn(into, code_of(F.col(vector), books))


def code_of(vector: Column, books: Codebooks) -> Column:
    """Struct of code and error of a vector column."""
    dims, trees = books.dims, [Tree(p) for p in books.parts]
    width = dims // len(trees)
    kind = pa.struct([("code", pa.string()), ("error", pa.int64())])

    @F.arrow_udf("struct<code: string, error: bigint>")
    def code(column: pa.Array) -> pa.Array:
        codes, errors = np.full(len(column), None, dtype=object), np.zeros(len(column), dtype=np.int64)
        for i in range(0, len(column), _BLOCK):
            rows, x = _vectors(column.slice(i, _BLOCK), dims)
            near = [t.nearest(x[:, k * width : (k + 1) * width]) for k, t in enumerate(trees)]
            digits = np.stack([n for n, _ in near], axis=1).astype(np.uint8)
            codes[i + rows] = [d.tobytes().hex() for d in digits]
            errors[i + rows] = sum(d for _, d in near)
        missing = pa.array([c is None for c in codes])
        return pa.StructArray.from_arrays([pa.array(codes, pa.string()), pa.array(errors, mask=np.asarray(missing))], fields=list(kind), mask=missing)

    return code(vector)


def label_errors(coded: DataFrame, label: str, into: str = "__code") -> DataFrame:
    """coded with long column label_error: the errors of all rows of an equal label, nulls together.

    coded is read twice and should be a stored table. Sums are pre-aggregated before the shuffle; the join's small side is left to the
    planner, and adaptive execution splits a label that holds many of the rows.
    """
    name, total = unused(coded, "label"), "label_error"
    sums = coded.groupBy(F.col(label).alias(name)).agg(F.sum(F.col(into)["error"]).alias(total))
    return coded.join(sums, F.col(label).eqNullSafe(F.col(name)), "left").drop(name)


def compressed(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """key, code, error, label_error, codebooks_sha256 of every kept vector.

    A table without a kept vector gives no rows. A null key takes no place among the first entries but
    has a code; see first_codebooks() and with_codes() for other lengths, repeats and large components.
    """
    rows = vectors.select(F.col(key), F.col(vector), F.col(label).alias("__label"))
    books = train(rows, parts, entries, rounds, key, vector)
    coded = stage(with_codes(rows, books, vector).select(key, "__label", "__code"), "coded")
    out = label_errors(coded, "__label")
    sha = F.lit(books.sha256() if books else None).cast("string")
    return out.select(key, F.col("__code")["code"].alias("code"), F.col("__code")["error"].alias("error"), "label_error", sha.alias("codebooks_sha256"))

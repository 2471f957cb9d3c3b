"""Weighted similarity of profiles, found in the cells of a grid and in boxes of near ones, not between all pairs.

The similarity of two profiles is 0.3 of the draft's, 0.5 of the measures' that both have, and 0.2 of the
schools'. One less the similarity is a weighted sum of absolute differences, and what one axis differs by is at
most that sum: profiles within a radius lie in equal or adjoining cells, whose sides are what the schools leave
of the radius. Measures that one side lacks change the weights of the others, so in large blocks there is a grid
for each set of shared measures that occurs; each pair is made in one grid alone.

A profile has the columns id, block, season, pick, round, school, style, and those of MEASURES. Null picks and
rounds count as the middle; blank schools as none; a null style is like no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidelag.functions.scalars import clip, fixed
from tidelag.sources.sinks import stored

# Weights, ranges and the number of comparisons kept.
DRAFT_WEIGHT, MEASURE_WEIGHT, SCHOOL_WEIGHT = 0.3, 0.5, 0.2
PICK_WEIGHT, ROUND_WEIGHT = 0.6, 0.4
PICK_RANGE, ROUND_RANGE = (1, 260), (1, 7)
MEASURES = {"wt": (150.0, 350.0), "forty": (4.2, 5.5), "vertical": (20.0, 46.0), "broad_jump": (90.0, 140.0)}
NO_MEASURES, SAME_STYLE, OTHER_SCHOOL = 0.5, 0.7, 0.3
COMPS, BUST_PPG = 5, 5.0

_TRAITS = ("block", "p", "r", *(f"m{i}" for i in range(len(MEASURES))), "bits", "school", "style")
_VALUES = ("p", "r", *(f"m{i}" for i in range(len(MEASURES))))
_SCALES = (DRAFT_WEIGHT * PICK_WEIGHT, DRAFT_WEIGHT * ROUND_WEIGHT, *[MEASURE_WEIGHT / len(MEASURES)] * len(MEASURES))
#: What distances in floats, and similarities of six digits, may be off by.
_HAIR = 4e-6
#: What pairs of the same school, the same style alone, and others are apart at least.
_APART = (0.0, SCHOOL_WEIGHT * (1 - SAME_STYLE), SCHOOL_WEIGHT * (1 - OTHER_SCHOOL))
#: Radius of the first round in blocks of up to so many classes; it shrinks with the fifth root beyond, as profiles differ in a draft and four measures.
_FIRST_RADIUS, _FIRST_BLOCK = 0.08, 2_000
#: Classes of a block from which on the measures have axes in the grid.
LARGE_BLOCK = 2_000_000
#: Places of a cell on the searching side that are compared at once, and a tenth of those that are searched.
TILE = 20_000
#: Places of a box and boxes of a crate, in which places are searched; rows, boxes of rows and pairs in arrays at once.
BOX, BOXES = 32, 16
ROWS_AT_ONCE, BOXES_AT_ONCE, PAIRS_AT_ONCE = 512, 16_384, 200_000
#: Tasks of a search: one for so many rows, at most so many.
ROWS_A_TASK, MOST_TASKS = 5_000, 1_000
#: Sides of cells that are compared in arrays, so that a cell holds more than a few.
LEAST_SIDE = 0.003


def _scaled(c: str, low: float, high: float) -> Column:
    return clip((F.col(c).cast("double") - low) / (high - low), 0, 1)


def profile_rows(profiles: DataFrame) -> DataFrame:
    """(id, season, traits) of every id; rows without id or block drop out, repeated rows are one."""
    school = F.nullif(F.trim("school"), F.lit(""))
    measures = [_scaled(m, *r).alias(f"m{i}") for i, (m, r) in enumerate(MEASURES.items())]
    middle = lambda c, r: F.coalesce(_scaled(c, *r), F.lit(0.5))
    p = profiles.where("id IS NOT NULL AND block IS NOT NULL").select(
        "id", "block", "season", middle("pick", PICK_RANGE).alias("p"), middle("round", ROUND_RANGE).alias("r"), *measures, school.alias("school"), F.when(school.isNotNull(), F.col("style")).alias("style")
    )
    bits = sum((F.when(F.col(f"m{i}").isNotNull(), 1 << i).otherwise(0) for i in range(len(MEASURES))), F.lit(0))
    return p.withColumn("bits", bits).distinct()


def profile_classes(profiles: DataFrame, by_season: bool = False, members: int = COMPS) -> DataFrame:
    """Equal profiles of a block, and of a season if asked for, as one row: its smallest id, its first ids, how many.

    Copies of one profile, however many, are one row from here on.
    """
    p = profile_rows(profiles)
    keys = [*_TRAITS, "season"] if by_season else list(_TRAITS)
    season = (F.col("season") if by_season else F.lit(None).cast("int")).alias("season")
    if members == 1:
        c = p.groupBy(*keys).agg(F.min("id").alias("id"), F.count("*").alias("n"))
        return c.select("id", F.array("id").alias("ids"), "n", season, *_TRAITS)
    # Each task keeps its first ids before the shuffle, so no group is gathered whole.
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
    first = p.withColumn("place", place).where(F.col("place") <= members).select(*keys, "id", F.lit(0).cast("long").alias("n"))
    counted = p.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("id", F.lit(None).cast(p.schema["id"].dataType))
    c = first.unionByName(counted).groupBy(*keys).agg(F.min("id").alias("id"), F.array_sort(F.collect_list("id")).alias("ids"), F.sum("n").alias("n"))
    return c.select("id", "ids", "n", season, *_TRAITS)


def class_of(profiles: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, q): every id and the id of its class; classes are by season.

    Classes whose ids are all of their members tell it themselves.
    """
    whole = F.col("n") == F.size("ids")
    own = classes.where(whole).select(F.explode("ids").alias("id"), F.col("id").alias("q"))
    if classes.where(~whole).isEmpty():
        return own
    c = classes.where(~whole).select(F.col("id").alias("q"), *[F.col(k).alias(f"o_{k}") for k in ("season", *_TRAITS)])
    large = profile_rows(profiles).join(c, [F.col(k).eqNullSafe(F.col(f"o_{k}")) for k in ("season", *_TRAITS)]).select("id", "q")
    return own.unionByName(large)


def _spots(classes: DataFrame, radius: float, masks: dict[int, list[int]] | None, around: bool) -> tuple[DataFrame, list[str]]:
    """classes once for each grid that they are in, at their cell, and the adjoining ones if asked for; and the join's keys.

    Without masks the grids have the draft's axis alone.
    """
    names = [F.when(F.lit(_APART[i] <= radius) & key.isNotNull(), F.struct(F.lit(i).alias("kind"), key.alias("name"))) for i, key in enumerate((F.col("school"), F.col("style"), F.lit("")))]
    d = classes.withColumn("k", F.explode(F.filter(F.array(*names), lambda x: x.isNotNull()))).select("*", "k.kind", "k.name").drop("k")
    apart = F.element_at(F.array(*map(F.lit, _APART)), F.col("kind") + 1)
    axes = [(DRAFT_WEIGHT * (PICK_WEIGHT * F.col("p") + ROUND_WEIGHT * F.col("r")), DRAFT_WEIGHT)]
    if masks is None:
        d = d.withColumn("mask", F.lit(-1))
    else:
        shared = F.lit(None).cast("array<int>")
        for bits, found in masks.items():
            shared = F.when(F.col("bits") == bits, F.array(*map(F.lit, found))).otherwise(shared)
        d, n, half = d.withColumn("mask", F.explode(shared)), F.bit_count("mask"), len(MEASURES) // 2
        apart += F.when(n == 0, MEASURE_WEIGHT * (1 - NO_MEASURES)).otherwise(0.0)
        part = lambda i: F.when(F.col("mask").bitwiseAND(1 << i) > 0, F.col(f"m{i}")).otherwise(0.0)
        axes += [(MEASURE_WEIGHT / F.greatest(n, F.lit(1)) * sum(map(part, those), F.lit(0.0)), MEASURE_WEIGHT) for those in (range(half), range(half, len(MEASURES)))]
    d = d.withColumn("side", F.lit(radius) - apart).where("side >= 0").withColumn("side", F.greatest("side", F.lit(LEAST_SIDE if masks is None else 1e-6)))
    for i, (at, most) in enumerate(axes):
        cell = F.floor(at / F.col("side")).cast("long")
        if around:  # a hair more than a side, as sums of doubles may differ by their rounding
            low = F.greatest(F.lit(0), F.floor((at - 1e-9) / F.col("side")) - 1).cast("long")
            high = F.least(F.floor((F.lit(most) + 1e-9) / F.col("side")), F.floor((at + 1e-9) / F.col("side")) + 1).cast("long")
            cell = F.explode(F.sequence(low, F.greatest(low, high)))
        d = d.withColumn(f"cell{i}", cell)
    return d, ["block", "kind", "name", "mask", *(f"cell{i}" for i in range(len(axes)))]


def similarity(a: str = "a", b: str = "b") -> Column:
    """Similarity of the struct columns a and b of class rows, to six digits."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    draft = 1 - (PICK_WEIGHT * F.abs(x("p") - y("p")) + ROUND_WEIGHT * F.abs(x("r") - y("r")))
    off = sum((F.coalesce(F.abs(x(f"m{i}") - y(f"m{i}")), F.lit(0.0)) for i in range(len(MEASURES))), F.lit(0.0))
    n = F.bit_count(x("bits").bitwiseAND(y("bits")))
    measures = F.when(n > 0, 1 - off / n).otherwise(NO_MEASURES)
    school = F.when(x("school") == y("school"), 1.0).when(x("style") == y("style"), SAME_STYLE).otherwise(OTHER_SCHOOL)
    return fixed(clip(DRAFT_WEIGHT * draft + MEASURE_WEIGHT * measures + SCHOOL_WEIGHT * school, 0, 1))


def largest_block(classes: DataFrame) -> int:
    """How many classes the largest block has."""
    return classes.groupBy("block").count().agg(F.max("count")).first()[0] or 0


def shared_masks(classes: DataFrame, large_block: int = LARGE_BLOCK) -> dict[int, list[int]] | None:
    """For each set of known measures that occurs, as bits, what it shares with those that occur; at most 2^len(MEASURES).

    None where no block is large: a row has up to some hundred places in the grids of all sets, which pay off
    only where a cell spares more pairs than that. The pairs found are the same.
    """
    if largest_block(classes) <= large_block:
        return None
    found = sorted(r.bits for r in classes.select("bits").distinct().collect())
    return {x: sorted({x & y for y in found}) for x in found}


def _sent(t: pa.Table) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Draft and measures of a table's rows as an array (0 for unknown), and the other columns as arrays."""
    values = np.column_stack([np.nan_to_num(t[c].to_numpy().astype(float)) for c in _VALUES])
    return values, {c: t[c].to_numpy() for c in t.column_names if c not in _VALUES}


def _halved(v: np.ndarray, at: np.ndarray) -> np.ndarray:
    """at in an order in which each run of BOX * BOXES places, and in it each of BOX, lies together in v."""
    out, todo = [], [at]
    while todo:
        here = todo.pop()
        if len(here) <= BOX:
            out.append(here)
            continue
        unit = BOX * BOXES if len(here) > BOX * BOXES else BOX
        cut, w = unit * (-(-len(here) // unit) // 2), v[here]
        order = np.argpartition(w[:, np.argmax(np.ptp(w, axis=0))], cut)
        todo += [here[order[cut:]], here[order[:cut]]]
    return np.concatenate(out)


class _Boxes:
    """Rows dealt to boxes of BOX near ones with the same known measures, and boxes to crates of BOXES; what is left over is empty."""

    def __init__(self, values: np.ndarray, bits: np.ndarray, seasons: np.ndarray | None) -> None:
        scale, places, self.bits = np.array(_SCALES), [], []
        for b in np.unique(bits):
            at = _halved((values * scale).astype(np.float32), np.flatnonzero(bits == b))
            crates = -(-len(at) // (BOX * BOXES))
            places.append(np.concatenate([at, np.full(crates * BOX * BOXES - len(at), -1)]))
            self.bits += [b] * crates
        self.bits, self.row = np.array(self.bits, np.int64), np.concatenate(places).reshape(-1, BOX)
        empty = self.row < 0
        # Empty places are infinitely far in the first axis, and in no box.
        self.at = [np.where(empty, np.inf if i == 0 else 0, values[self.row, i]).astype(np.float32) for i in range(values.shape[1])]
        self.low = [a.min(1).reshape(-1, BOXES) for a in self.at]
        self.high = [np.where(empty, -np.inf if i == 0 else 0, a).max(1).reshape(-1, BOXES) for i, a in enumerate(self.at)]
        self.known = BOX * BOXES - empty.reshape(len(self.bits), -1).sum(1)
        if seasons is not None:
            self.season = np.where(empty, np.iinfo(np.int32).max, seasons[self.row]).astype(np.int32)
            self.first = self.season.min(1).reshape(-1, BOXES)

    def weighed(self, bits: int, apart: float) -> None:
        """Set the axes' weights, and all coordinates times them, for rows that know the measures of bits."""
        shared = self.bits & bits
        n = np.bitwise_count(shared)
        self.base = (apart + np.where(n > 0, 0.0, MEASURE_WEIGHT * (1 - NO_MEASURES))).astype(np.float32)
        measure = MEASURE_WEIGHT / np.maximum(n, 1)
        self.axes = [0, 1, *(2 + i for i in range(len(MEASURES)) if bits >> i & 1)]
        self.weight = {i: (np.full(len(n), _SCALES[i]) if i < 2 else np.where(shared >> (i - 2) & 1, measure, 0.0)).astype(np.float32) for i in self.axes}
        self.w_at = {i: self.at[i] * np.repeat(w, BOXES)[:, None] for i, w in self.weight.items()}
        self.w_low, self.w_high = ({i: side[i] * w[:, None] for i, w in self.weight.items()} for side in (self.low, self.high))
        self.c_low, self.c_high = {i: a.min(1) for i, a in self.w_low.items()}, {i: a.max(1) for i, a in self.w_high.items()}

    def crates_away(self, x: np.ndarray) -> np.ndarray:
        """At least how far each row is from what is in each crate."""
        total = np.repeat(self.base[None], len(x), 0)
        for i in self.axes:
            v = x[:, i, None] * self.weight[i][None]
            total += np.maximum(np.maximum(self.c_low[i] - v, v - self.c_high[i]), 0)
        return total

    def boxes_away(self, x: np.ndarray, crate: np.ndarray) -> np.ndarray:
        """At least how far row i is from what is in each box of crate[i]."""
        total = np.repeat(self.base[crate][:, None], BOXES, 1)
        for i in self.axes:
            v = (x[:, i] * self.weight[i][crate])[:, None]
            total += np.maximum(np.maximum(self.w_low[i][crate] - v, v - self.w_high[i][crate]), 0)
        return total

    def away(self, x: np.ndarray, box: np.ndarray) -> np.ndarray:
        """How far row i is from each place of box[i], to float precision."""
        crate = box // BOXES
        total = np.repeat(self.base[crate][:, None], BOX, 1)
        for i in self.axes:
            off = self.w_at[i][box]
            off -= (x[:, i] * self.weight[i][crate])[:, None]
            total += np.abs(off, out=off)
        return total


def _rounded(x: np.ndarray) -> np.ndarray:
    """fixed() of numbers that are not negative: ties go up, by the number's shortest decimal form."""
    x = x + 1e-9
    t = x * 1e6
    out = np.floor(t + 0.5) / 1e6
    for i in np.flatnonzero(np.abs(t - np.floor(t) - 0.5) < 1e-6):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return out


def _similar(x: np.ndarray, y: np.ndarray, bits: np.ndarray, kind: int) -> np.ndarray:
    """similarity() of rows whose shared measures are bits and whose schools are of a kind, term by term as Spark adds them."""
    draft = 1 - (PICK_WEIGHT * np.abs(x[:, 0] - y[:, 0]) + ROUND_WEIGHT * np.abs(x[:, 1] - y[:, 1]))
    off = np.zeros(len(x))
    for i in range(len(MEASURES)):
        off += np.where(bits >> i & 1, np.abs(x[:, 2 + i] - y[:, 2 + i]), 0.0)
    n = np.bitwise_count(bits)
    measures = np.where(n > 0, 1 - off / np.maximum(n, 1), NO_MEASURES)
    schools = (1.0, SAME_STYLE, OTHER_SCHOOL)[kind]
    return _rounded(np.clip(DRAFT_WEIGHT * draft + MEASURE_WEIGHT * measures + SCHOOL_WEIGHT * schools, 0, 1))


def _searched(radius: float, best: int | None, id_type: pa.DataType):
    """Function of a group's rows, both sides, as record batches: the pairs found, as batches.

    With `best` (a, b, similarity) with an earlier b, of those of an a as many as the best, with all that nearly tie,
    within the a's own bound where it has one. Without, (a, b, similarity, a_size, b_size) with a < b whose similarity is at least 1 - radius.
    Rows meet boxes that may hold something near enough; a hair more than asked for is kept before similarities are rounded.
    """
    sizes = best is None
    out = pa.schema([("a", id_type), ("b", id_type), ("similarity", pa.float64()), *((c, pa.int64()) for c in ("a_size", "b_size") if sizes)])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        t = t.set_column(t.column_names.index("school"), "school", _codes(t["school"])).set_column(t.column_names.index("style"), "style", _codes(t["style"]))
        (xv, x), (yv, y) = (_sent(t.filter(pc.equal(t["side"], i))) for i in (0, 1))
        if not len(xv) or not len(yv):
            return
        level, apart = int(x["kind"][0]), _APART[int(x["kind"][0])]
        seasons = None if sizes else np.unique(np.concatenate([x["season"], y["season"]]))
        xs, ys = (None, None) if sizes else (np.searchsorted(seasons, d["season"]).astype(np.int32) for d in (x, y))
        boxes = _Boxes(yv, y["bits"], ys)
        of = boxes.row

        def other(q: np.ndarray, j: np.ndarray) -> np.ndarray:
            """Whether pairs are of no nearer kind, which find each other there."""
            ok = np.ones(np.broadcast_shapes(q.shape, j.shape), bool)
            for c in ("school", "style")[:level]:
                ok &= (x[c][q] != y[c][j]) | (x[c][q] < 0)
            return ok

        def batch(q: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
            s = _similar(xv[q], yv[j], x["bits"][q] & y["bits"][j], level)
            found = [x["id"][q], y["id"][j], s, *((x["n"][q], y["n"][j]) if sizes else ())]
            if sizes:
                keep = s >= 1 - radius - 1e-9
                found = [c[keep] for c in found]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(found, out, strict=True)], schema=out)

        for bits in np.unique(x["bits"]):
            boxes.weighed(int(bits), apart)
            rows = np.flatnonzero(x["bits"] == bits)
            for start in range(0, len(rows), ROWS_AT_ONCE):
                q = rows[start : start + ROWS_AT_ONCE]
                v = xv[q].astype(np.float32)
                crates = boxes.crates_away(v)
                if sizes:
                    reach = np.full(len(q), radius + _HAIR, np.float32)
                else:
                    crates[boxes.first.min(1)[None] >= xs[q, None]] = np.inf
                    reach = np.minimum(_reach(boxes, crates, v, q, xs, best, other), np.nan_to_num(x["bound"][q].astype(float), nan=np.inf) + _HAIR).astype(np.float32)
                found, kept = [], 0
                pairs = np.nonzero(crates <= reach[:, None])
                for at in range(0, len(pairs[0]), BOXES_AT_ONCE // BOXES):
                    i, crate = (p[at : at + BOXES_AT_ONCE // BOXES] for p in pairs)
                    near = boxes.boxes_away(v[i], crate) <= reach[i, None]
                    if not sizes:
                        near &= boxes.first[crate] < xs[q[i], None]
                    i2, b = np.nonzero(near)
                    i, box = i[i2], crate[i2] * BOXES + b
                    away = boxes.away(v[i], box)
                    hit = away <= reach[i, None]
                    if not sizes:
                        hit &= boxes.season[box] < xs[q[i], None]
                    i2, b = np.nonzero(hit)
                    i, j, d = i[i2], of[box[i2], b], away[i2, b]
                    keep = other(q[i], j)
                    if sizes:
                        keep &= x["id"][q[i]] < y["id"][j]
                    found.append((i[keep], j[keep], d[keep]))
                    kept += int(keep.sum())
                    if kept >= PAIRS_AT_ONCE:
                        i, j, d = map(np.concatenate, zip(*found, strict=True))
                        if sizes:
                            yield batch(q[i], j)
                            found, kept = [], 0
                        else:
                            found, reach = _best(i, j, d, best, reach)
                            kept = 0
                if found:
                    i, j, d = map(np.concatenate, zip(*found, strict=True))
                    if not sizes:
                        ((i, j, d),), _ = _best(i, j, d, best, reach)
                    yield batch(q[i], j)

    return searched


def _codes(c: pa.ChunkedArray) -> pa.Array:
    """Equal texts as equal numbers, null as -1."""
    return pc.fill_null(c.combine_chunks().dictionary_encode().indices, -1)


def _reach(boxes: _Boxes, crates: np.ndarray, v: np.ndarray, q: np.ndarray, xs: np.ndarray, best: int, other) -> np.ndarray:
    """How far the best of each row are at most, by the nearest crates; infinite where those hold too few."""
    few = np.where(boxes.known < 8 * best, np.float32(1), np.float32(0))
    look = min(2, crates.shape[1])
    crate = np.argpartition(crates + few, look - 1, axis=1)[:, :look]
    box = (crate[:, :, None] * BOXES + np.arange(BOXES)).reshape(len(q), -1)
    i = np.repeat(np.arange(len(q)), box.shape[1])
    box = box.ravel()
    away = boxes.away(v[i], box)
    away[~((boxes.season[box] < xs[q[i], None]) & other(q[i, None], boxes.row[box]))] = np.inf
    return np.partition(away.reshape(len(q), -1), best - 1, axis=1)[:, best - 1] + _HAIR


def _best(i: np.ndarray, j: np.ndarray, d: np.ndarray, best: int, reach: np.ndarray) -> tuple[list, np.ndarray]:
    """Pairs (i, j) that are as near as the best of i, nearly, and how far these are at most."""
    order = np.argsort(d)
    order = order[np.argsort(i[order].astype(np.int16), kind="stable")]  # rows at once are few, and small numbers are quickly sorted
    i, j, d = i[order], j[order], d[order]
    first = np.searchsorted(i, np.arange(len(reach)))
    n = np.diff(np.append(first, len(i)))
    last = np.minimum(first + best - 1, max(len(i) - 1, 0))
    reach = np.where(n >= best, np.minimum(reach, (d[last] if len(d) else np.inf) + _HAIR), reach).astype(np.float32)
    keep = d <= reach[i]
    return [(i[keep], j[keep], d[keep])], reach


def _searched_together(x: DataFrame, y: DataFrame, on: list[str], radius: float, best: int | None) -> DataFrame:
    """Pairs of x and y that meet under the keys `on`, by _searched(), one pair of tiles of a key at a time."""
    most = lambda d: d.groupBy(*on).count().agg(F.max("count"), F.sum("count")).first()
    (gx, rows_x), (gy, rows_y) = ((m or 0, n or 0) for m, n in (most(x), most(y)))
    rows = min(TILE, max(gx // 8, TILE // 5))
    nx, ny = -(-gx // rows) or 1, -(-gy // (10 * TILE)) or 1
    tile = lambda d, side, n, own, m, other: d.withColumn("side", F.lit(side)).withColumn(own, F.pmod(F.xxhash64("id"), F.lit(n))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))))
    both = tile(x, 0, nx, "x_tile", ny, "y_tile").unionByName(tile(y, 1, ny, "y_tile", nx, "x_tile"), allowMissingColumns=True)
    keys = [*on, "x_tile", "y_tile"]
    id_type = x.schema["id"].dataType
    parts = max(1, min(MOST_TASKS, (rows_x * ny + rows_y * nx) // ROWS_A_TASK))
    schema = f"a {id_type.simpleString()}, b {id_type.simpleString()}, similarity double" + (", a_size long, b_size long" if best is None else "")
    return both.repartition(parts, *keys).groupBy(*keys).applyInArrow(_searched(radius, best, to_arrow_type(id_type)), schema)


def pairs_within(left: DataFrame, right: DataFrame, radius: float, masks: dict[int, list[int]] | None) -> DataFrame:
    """(a, b, similarity, a_size, b_size) with a < b: class rows of one block whose similarity, to six digits, is at least 1 - radius.

    masks are of both sides. The cells of the draft's axis are searched in arrays.
    """
    reach = radius + 2e-6  # what rounding may add
    (x, on), (y, _) = _spots(left, reach, masks, True), _spots(right, reach, masks, False)
    if masks is None:
        columns = ["id", "n", *[c for c in _TRAITS if c != "block"], *on]
        return _searched_together(x.select(*columns), y.select(*columns), on, radius, None)
    j = _meetings(x, y, on).where("a.id < b.id").select("a", "b", similarity().alias("similarity")).where(F.col("similarity") >= F.lit(1 - radius - 1e-9))
    return j.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), "similarity", F.col("a.n").alias("a_size"), F.col("b.n").alias("b_size"))


def _meetings(x: DataFrame, y: DataFrame, on: list[str]) -> DataFrame:
    """(a, b) of class rows that share a cell of the grid of their shared measures, each pair once."""
    row = F.struct("id", "ids", "n", "season", *_TRAITS)
    # Places outnumber the classes by far, which the files' size doesn't tell: neither side may be broadcast.
    j = x.select(*on, row.alias("a")).hint("merge").join(y.select(*on, row.alias("b")), on)
    kind = F.when(F.col("a.school") == F.col("b.school"), 0).when(F.col("a.style") == F.col("b.style"), 1).otherwise(2)
    return j.where((kind == F.col("kind")) & (F.col("a.bits").bitwiseAND(F.col("b.bits")) == F.col("mask"))).select("a", "b")


def similarity_graph(profiles: DataFrame, least: float, large_block: int = LARGE_BLOCK) -> DataFrame:
    """Edges (a, b, similarity, a_size, b_size) with a < b between classes of equal profiles of a block, all that reach `least`.

    An id's class is that of profile_classes(); members of one class are equal and need no edge.
    """
    c = stored(profile_classes(profiles, members=1), "classes")
    return pairs_within(c, c, 1 - least, shared_masks(c, large_block))


def _best_of(pairs: DataFrame, k: int) -> DataFrame:
    """The k most similar comp of each q, ties by comp, stored."""
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("similarity"), "comp"))
    return stored(pairs.withColumn("place", place).where(F.col("place") <= k).drop("place"), "best")


def _nearest_by_radius(waiting: DataFrame, classes: DataFrame, masks: dict[int, list[int]], k: int) -> DataFrame | None:
    """(q, comp, similarity) in the grid of all axes: the radius doubles until each class has its k within it, and only classes that lack some go on."""
    answers = None
    radius = _FIRST_RADIUS * min(1.0, _FIRST_BLOCK / max(largest_block(classes), 1)) ** 0.2
    while not waiting.isEmpty():
        radius = min(radius, 1.0)
        (x, on), (y, _) = _spots(waiting.drop("need"), radius + 2e-6, masks, True), _spots(classes, radius + 2e-6, masks, False)
        pairs = _meetings(x, y, on).where("a.season > b.season").select("a", "b", similarity().alias("similarity")).where(F.col("similarity") >= F.lit(1 - radius - 1e-9))
        best = _best_of(pairs.select(F.col("a.id").alias("q"), F.explode("b.ids").alias("comp"), "similarity"), k)
        have = best.groupBy("q").agg(F.count("*").alias("have"))
        done = stored(have.join(waiting.select(F.col("id").alias("q"), "need"), "q").where(F.lit(radius == 1.0) | (F.col("have") >= F.col("need"))).select("q"), "done")
        part = best.join(done, "q")
        answers = part if answers is None else answers.unionByName(part)
        if radius == 1.0:
            break
        waiting = stored(waiting.join(done.withColumnRenamed("q", "id"), "id", "left_anti"), "waiting")
        radius *= 2
    return answers


def _nearest_by_kind(waiting: DataFrame, classes: DataFrame, k: int) -> DataFrame | None:
    """(q, comp, similarity): the best of the same school, then of the same style, then of all others.

    Only classes go on that lack some, or whose last one is no more similar than the next kind can be.
    """
    answers, best = None, None
    columns = ["id", "season", *_TRAITS]
    points = classes.select(F.explode("ids").alias("id"), *columns[1:])
    x = waiting.select(*columns, "need", F.lit(None).cast("double").alias("bound"))
    for kind, name in enumerate(("school", "style", None)):
        at = lambda d: d.withColumn("kind", F.lit(kind)).withColumn("name", F.col(name) if name else F.lit("")).where("name IS NOT NULL")  # noqa: B023, E731
        found = _searched_together(at(x.drop("need")), at(points), ["block", "kind", "name"], 1.0, k).select(F.col("a").alias("q"), F.col("b").alias("comp"), "similarity")
        best = _best_of(found if best is None else found.unionByName(best), k)
        if name is None:
            return best if answers is None else answers.unionByName(best)
        have = best.groupBy("q").agg(F.count("*").alias("have"), F.min("similarity").alias("last")).withColumnRenamed("q", "id")
        more = F.col("have").isNull() | (F.col("have") < F.col("need")) | ((F.col("have") == k) & (F.col("last") <= 1 - _APART[kind + 1] + 2e-6))
        x = stored(x.drop("bound").join(have.hint("merge"), "id", "left").where(more).select(*columns, "need", F.when(F.col("have") == k, 1 - F.col("last")).alias("bound")), "waiting")
        left = x.select(F.col("id").alias("q")).hint("merge")
        part = best.join(left, "q", "left_anti")
        answers = part if answers is None else answers.unionByName(part)
        if x.isEmpty():
            return answers
        best = best.join(left, "q", "left_semi")
    return answers


def nearest_earlier(profiles: DataFrame, k: int = COMPS, large_block: int = LARGE_BLOCK) -> DataFrame:
    """(id, comp, similarity): for each profile the k most similar ones of the same block and an earlier season.

    Ties go to the smaller id; fewer than k where the block has no more. Exact. Of equal earlier profiles only
    the first k can be among the best, and equal later ones share their answer.
    """
    known = profiles.where("season IS NOT NULL")
    classes = stored(profile_classes(known, by_season=True, members=k), "classes")
    sizes = classes.groupBy("block", "season").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.partitionBy("block").orderBy("season").rowsBetween(Window.unboundedPreceding, -1))
    need = sizes.select("block", "season", F.least(before, F.lit(k)).alias("need")).where("need > 0")
    waiting, masks = stored(classes.join(need, ["block", "season"]), "waiting"), shared_masks(classes, large_block)
    answers = _nearest_by_kind(waiting, classes, k) if masks is None else _nearest_by_radius(waiting, classes, masks, k)
    if answers is None:
        return classes.select("id", F.col("id").alias("comp"), F.lit(0.0).alias("similarity")).limit(0)
    return class_of(known, classes).join(answers.select("q", "comp", "similarity"), "q").select("id", "comp", "similarity")


def comparison_features(comps: DataFrame, bust: float = BUST_PPG) -> DataFrame:
    """Ceiling, floor, median, bust share and years of the comparisons whose best season is known.

    comps has player_id, comp_nfl_ppg, comp_best_season_ppg, comp_seasons_played.
    """
    best = F.col("comp_best_season_ppg")
    return comps.where(best.isNotNull()).groupBy("player_id").agg(
        F.percentile(best, 0.75).alias("prospect_comp_ceiling"), F.percentile(best, 0.25).alias("prospect_comp_floor"), F.percentile(best, 0.5).alias("prospect_comp_median"),
        F.avg((F.col("comp_nfl_ppg") < bust).cast("int")).alias("prospect_comp_bust_rate"), F.avg("comp_seasons_played").alias("years_to_breakout_comp"),
    )

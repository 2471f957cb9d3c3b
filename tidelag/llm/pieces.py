"""SentencePiece encoding and decoding by suffix-array matching.

The distinct words of a batch are laid end to end and their suffixes sorted; every piece of the
vocabulary is found in them by binary search, which gives all places where it occurs. The occurrences
are edges from their first to their last character. Taken in the order of their ends they are relaxed:
the prefix that ends at an edge's end is encoded by the one edge whose piece may follow the last piece
of the prefix before it. For a vocabulary of merges that test is exact: two pieces may stand side by
side if merging their joined text gives them back, and a row of pieces is the encoding of its text if
each neighbouring pair may.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Characters in one sorting key.
BLOCK = 5
#: Slots of the table that remembers which pairs may stand side by side.
PAIR_SLOTS = 1 << 21
#: Characters of new words matched at once, and words that a worker remembers at most.
MATCH_CHARS = 100_000
REMEMBERED = 150_000
#: A word of more characters is relaxed by itself, edge by edge.
LONG_WORD = 4096
#: Characters of text that are encoded before their ids are handed on.
PART_CHARS = 500_000
_NEVER = np.iinfo(np.int32).max
_chunks = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n").findall


@dataclass(frozen=True)
class Pieces:
    """Vocabulary arrays, made once on the driver; they grow with the vocabulary only.

    text[i] is the piece of id i and kind[i] 0 for text, 1 for a byte, 2 for none; rank[i] is when its
    merge is made, -1 for a single character; left[i], right[i] are the pieces of its last merge;
    edge_ids are those that encode to themselves. pair_keys, sorted, and pair_ranks tell which pairs
    merge and when. Pieces that hold a repeated space share one rank and are left to merge_plainly().
    """

    text: tuple[str, ...]
    kind: np.ndarray
    rank: np.ndarray
    left: np.ndarray
    right: np.ndarray
    edge_ids: np.ndarray
    pair_keys: np.ndarray
    pair_ranks: np.ndarray
    unknown: int

    @classmethod
    def read(cls, path: str = MODEL) -> Pieces:
        """Raises ValueError for a model that is not of merges with byte fallback and plain spaces."""
        p = sentencepiece.SentencePieceProcessor(model_file=path)
        n = p.get_piece_size()
        text = tuple(p.id_to_piece(i) for i in range(n))
        kind = np.array([1 if p.is_byte(i) else 2 if p.is_control(i) or p.is_unknown(i) or p.is_unused(i) else 0 for i in range(n)], dtype=np.int8)
        ids = {text[i]: i for i in range(n) if kind[i] == 0}
        if (kind == 1).sum() != 256 or any(SPACE in t.lstrip(SPACE) or "\n" in t or any(c not in ids for c in t) for t in ids):
            raise ValueError("not a vocabulary of merges with byte fallback and pieces within words")
        scores = sorted({p.get_score(i) for t, i in ids.items() if len(t) > 1}, reverse=True)
        order = {s: k for k, s in enumerate(scores)}
        rank = np.full(n, -1, dtype=np.int32)
        left, right = np.full(n, -1, dtype=np.int32), np.full(n, -1, dtype=np.int32)
        pairs: dict[int, int] = {}
        for t, i in ids.items():
            if len(t) > 1:
                rank[i] = order[p.get_score(i)]
                for k in range(1, len(t)):
                    if (a := ids.get(t[:k])) is not None and (b := ids.get(t[k:])) is not None:
                        pairs[a << 32 | b] = int(rank[i])
        merges = {(k >> 32, k & 0xFFFFFFFF): (r, ids[text[k >> 32] + text[k & 0xFFFFFFFF]]) for k, r in pairs.items()}
        edges = []
        for t, i in ids.items():
            row, last = merge_plainly([ids[c] for c in t], merges)
            if row == [i] and SPACE * 2 not in t:
                edges.append(i)
                if last:
                    left[i], right[i] = last
        keys = np.array(sorted(pairs), dtype=np.int64)
        return cls(text, kind, rank, left, right, np.array(sorted(edges)), keys, np.array([pairs[k] for k in keys.tolist()], dtype=np.int32), p.unk_id())


def merge_plainly(row: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> tuple[list[int], tuple[int, int] | None]:
    """Merge the best pair, leftmost first, until none is left; also the last pair merged.

    A heap of the pairs that stand side by side, with links over what was merged, so a long row takes
    n log n steps.
    """
    row, last, n = list(row), None, len(row)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(merges[x][0], k, *x) for k, x in enumerate(zip(row, row[1:], strict=False)) if x in merges]
    heapq.heapify(heap)
    while heap:
        _, k, a, b = heapq.heappop(heap)
        r = after[k]
        if row[k] != a or r >= n or row[r] != b:
            continue  # one of the two was merged since
        last = (a, b)
        row[k], row[r] = merges[last][1], -1
        after[k] = after[r]
        if after[r] < n:
            before[after[r]] = k
        for left, right in ((before[k], k), (k, after[k])):
            if left >= 0 and right < n and (m := merges.get((row[left], row[right]))):
                heapq.heappush(heap, (m[0], left, row[left], row[right]))
    at, out = 0, []
    while at < n:
        out.append(row[at])
        at = after[at]
    return out, last


class Encoder:
    """What a worker keeps: the vocabulary's search keys, known pairs and known words."""

    def __init__(self, v: Pieces):
        self.v = v
        edge_text = [v.text[i] for i in v.edge_ids]
        alphabet = sorted({c for t in v.text for c in t} | {SPACE})
        self._code = np.zeros(0x110000, dtype=np.int64)  # 0 for characters of no piece
        self._code[[ord(c) for c in alphabet]] = np.arange(2, len(alphabet) + 2)  # 1 ends a word
        self._bits = int(len(alphabet) + 2).bit_length()
        if self._bits * BLOCK > 62:
            raise ValueError("the alphabet is too large for the sorting keys")
        self._ids = {v.text[i]: i for i in range(len(v.text)) if v.kind[i] == 0}
        self._sizes = np.array([len(t) for t in v.text] + [1])
        self._single = np.full(len(alphabet) + 2, -1, dtype=np.int32)
        for k, c in enumerate(alphabet):
            self._single[k + 2] = self._ids.get(c, -1)
        # blocks of a piece as keys of its first and last possible continuation
        self._pieces = []
        for i, t in zip(v.edge_ids.tolist(), edge_text, strict=True):
            if len(t) > 1:
                c = self._code[[ord(x) for x in t]]
                self._pieces.append((i, len(t), [c[k : k + BLOCK] for k in range(0, len(t), BLOCK)]))
        self._merges = {(k >> 32, k & 0xFFFFFFFF): (int(r), self._ids[v.text[k >> 32] + v.text[k & 0xFFFFFFFF]]) for k, r in zip(v.pair_keys.tolist(), v.pair_ranks.tolist(), strict=True)}
        self._lists = v.rank.tolist(), v.left.tolist(), v.right.tolist()
        self._levels = self._search_plan()
        self._slot_keys = np.full(PAIR_SLOTS, -1, dtype=np.int64)
        self._slot_values = np.zeros(PAIR_SLOTS, dtype=bool)
        self._byte = {bytes([b]): i for b, i in zip(range(256), np.flatnonzero(v.kind == 1).tolist(), strict=True)}
        self._bytes = [bytes([i - int(np.flatnonzero(v.kind == 1)[0])]) if v.kind[i] == 1 else b"" if v.kind[i] == 2 else v.text[i].encode() for i in range(len(v.text))]
        self._is_byte = v.kind == 1
        self.forget()

    def forget(self) -> None:
        self._known: dict[str, int] = {}
        self._flat = np.zeros(0, dtype=np.int32)
        self._offsets = np.zeros(1, dtype=np.int64)

    def _key(self, codes: np.ndarray, fill: int) -> int:
        k = 0
        for j in range(BLOCK):
            k = k << self._bits | (int(codes[j]) if j < len(codes) else fill)
        return k

    def _search_plan(self) -> list[tuple[np.ndarray, ...]]:
        """For each block of a piece's text: (group, low key, high key, piece, next group) of every piece or shared prefix.

        A piece that ends in the block has next group -1; a longer one has piece -1 and the group of its prefix.
        """
        high = (1 << self._bits) - 1
        levels, groups = [], {(): 0}
        for depth in range(max((len(b) for _, _, b in self._pieces), default=0)):
            rows: list[tuple[int, int, int, int, int]] = []
            following: dict[tuple, int] = {}
            for i, _, blocks in self._pieces:
                if len(blocks) <= depth:
                    continue
                g, b = groups[tuple(tuple(x) for x in blocks[:depth])], blocks[depth]
                if len(blocks) == depth + 1:
                    rows.append((g, self._key(b, 0), self._key(b, high), i, -1))
                elif (p := tuple(tuple(x) for x in blocks[: depth + 1])) not in following:
                    following[p] = len(following)
                    rows.append((g, self._key(b, 0), self._key(b, high), -1, following[p]))
            levels.append(tuple(np.array(x, dtype=np.int64) for x in zip(*rows, strict=True)))
            groups = following
        return levels

    def _edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and pieces of all occurrences of pieces of two characters or more."""
        n = len(codes)
        padded = np.concatenate([codes, np.ones(BLOCK, dtype=np.int64)])
        key = np.zeros(n, dtype=np.int64)
        for j in range(BLOCK):
            key = key << self._bits | padded[j : j + n]
        starts, pieces = [], []
        at, group = np.arange(n), np.zeros(n, dtype=np.int64)  # suffixes to sort, by group of their prefix
        for depth, (g, low, high, piece, following) in enumerate(self._levels):
            shifted = at + depth * BLOCK
            k = np.where(shifted < n, key[np.minimum(shifted, n - 1)], 0)
            order = np.lexsort((k, group)) if depth else np.argsort(k)
            at, group, k = at[order], group[order], k[order]
            if depth:  # group and key as one number
                keys, k = np.unique(k, return_inverse=True)
                joined, wide = group * (len(keys) + 1) + k, g * (len(keys) + 1)
                a = np.searchsorted(joined, wide + np.searchsorted(keys, low, "left"), "left")
                b = np.searchsorted(joined, wide + np.searchsorted(keys, high, "right"), "left")
            else:
                a, b = np.searchsorted(k, low, "left"), np.searchsorted(k, high, "right")
            size = b - a
            which = np.repeat(np.arange(len(size)), size)
            place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + a[which]
            done = piece[which] >= 0
            starts.append(at[place[done]])
            pieces.append(piece[which[done]])
            at, group = at[place[~done]], following[which[~done]]
            if not len(at):
                break
        return np.concatenate(starts), np.concatenate(pieces)

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the joined text of pieces a[i] and b[i] gives them back; -1, an unknown character, never merges."""
        out = np.ones(len(a), dtype=bool)
        key = a.astype(np.int64) << 32 | b
        slot = (key * -7046029254386353131 >> 43) & (PAIR_SLOTS - 1)
        both = (a >= 0) & (b >= 0)
        hit = both & (self._slot_keys[slot] == key)
        out[hit] = self._slot_values[slot[hit]]
        todo = np.flatnonzero(both & ~hit)
        if len(todo):
            key, slot = key[todo], slot[todo]
            out[todo] = value = self._unmerge(a[todo], b[todo])
            self._slot_keys[slot], self._slot_values[slot] = key, value
            clash = self._slot_keys[slot] != key  # two keys for a slot: the value must be that of the key that stays
            if clash.any():
                keep = ~clash
                self._slot_values[slot[keep]] = value[keep]
        return out

    def _unmerge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Undo the later of the two pieces' last merges until single characters are left.

        The pair that faces each other across the border must never be merged before the merge that was undone.
        """
        v = self.v
        a, b = a.astype(np.int64), b.astype(np.int64)
        ok, limit, live = np.ones(len(a), dtype=bool), np.full(len(a), _NEVER, dtype=np.int64), np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = x << 32 | y
            i = np.minimum(np.searchsorted(v.pair_keys, key), len(v.pair_keys) - 1)
            merged = np.where(v.pair_keys[i] == key, v.pair_ranks[i], _NEVER)
            bad = merged < limit[live]
            ok[live[bad]] = False
            rx, ry = v.rank[x], v.rank[y]
            go = ~bad & (np.maximum(rx, ry) >= 0)
            undo_left = rx > ry
            limit[live] = np.where(undo_left, rx, ry + 1)  # among equals the left one merges first
            a[live] = np.where(undo_left & go, v.right[x], x)
            b[live] = np.where(~undo_left & go, v.left[y], y)
            live = live[go]
        return ok

    def _unmerge_one(self, a: int, b: int) -> bool:
        """_unmerge() of one pair, without arrays."""
        rank, left, right = self._lists
        limit = _NEVER
        while True:
            if (m := self._merges.get((a, b))) and m[0] < limit:
                return False
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, right[a]
            else:
                limit, b = rb + 1, left[b]

    def _encode_new(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, which hold no repeated space, and the offsets of each; unknown characters as bytes."""
        text = "\n".join(words) + "\n"
        points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
        codes = self._code[points]
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        codes[ends] = 1
        n = len(codes)
        begin = np.concatenate([[0], ends[:-1] + 1])
        own = np.repeat(begin, ends - begin + 1)  # first character of each character's word
        s, p = self._edges(codes)
        inside = np.flatnonzero(codes != 1)
        s, p = np.concatenate([s, inside]), np.concatenate([p, self._single[codes[inside]]])
        size = self._sizes[p]
        e = s + size
        depth = e - own[s]
        order = np.argsort(depth.astype(np.uint16) if depth.max(initial=0) < 65536 else depth, kind="stable")
        s, p, e = s[order], p[order].astype(np.int32), e[order]
        cuts = np.searchsorted(depth[order], np.arange(1, depth.max(initial=0) + 2))
        last, back, count = np.full(n + 1, -2, dtype=np.int32), np.zeros(n + 1, dtype=np.int64), np.zeros(n + 1, dtype=np.int64)
        # the prefix that ends before character i is kept at i; a word's first has no last piece
        first = np.zeros(n + 1, dtype=bool)
        first[begin] = True
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            x, y, z = s[lo:hi], p[lo:hi], e[lo:hi]
            free = first[x]
            ok = free.copy()
            check = np.flatnonzero(~free)
            ok[check] = self.may_follow(last[x[check]], y[check])
            x, y, z = x[ok], y[ok], z[ok]
            last[z], back[z], count[z] = y, x, np.where(first[x], 0, count[x]) + 1
        total = np.where(ends > begin, count[ends], 0)
        offsets = np.concatenate([[0], np.cumsum(total)])
        out = np.zeros(offsets[-1], dtype=np.int32)
        at, word = ends[ends > begin], np.flatnonzero(ends > begin)
        slot = offsets[word + 1] - 1
        while len(at):
            unknown = last[at] == -1
            out[slot] = np.where(unknown, -1 - points[back[at]].astype(np.int64), last[at])
            at = back[at]
            more = ~first[at]
            at, slot = at[more], slot[more] - 1
        if (out < 0).any():
            out, offsets = self._spell(out, offsets)
        return out, offsets

    def _encode_long(self, word: str) -> np.ndarray:
        """Ids of one long word: its edges in the order of their ends, relaxed one by one."""
        codes = self._code[np.frombuffer(word.encode("utf-32-le", "replace"), dtype=np.uint32)]
        n = len(codes)
        s, p = self._edges(codes)
        s, p = np.concatenate([s, np.arange(n)]), np.concatenate([p, self._single[codes]])
        e = s + self._sizes[p]
        order = np.argsort(e, kind="stable")
        last, back, known = [-2] * (n + 1), [0] * (n + 1), {}
        for start, piece, end in zip(s[order].tolist(), p[order].tolist(), e[order].tolist(), strict=True):
            if start and (left := last[start]) >= 0 and piece >= 0:
                if (ok := known.get(pair := left << 32 | piece)) is None:
                    ok = known[pair] = self._unmerge_one(left, piece)
                if not ok:
                    continue
            last[end], back[end] = piece, start
        out, at = [], n
        while at:
            out.append(last[at] if last[at] >= 0 else -1 - ord(word[back[at]]))
            at = back[at]
        row = np.array(out[::-1], dtype=np.int32)
        return self._spell(row, np.array([0, len(row)]))[0] if (row < 0).any() else row

    def _spell(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each unknown character, marked by its negated code point less 1, becomes the pieces of its bytes."""
        bad = np.flatnonzero(ids < 0)
        spelt = [[self._byte[bytes([b])] for b in chr(-i - 1).encode("utf-8", "replace")] for i in ids[bad].tolist()]
        width = np.ones(len(ids), dtype=np.int64)
        width[bad] = [len(x) for x in spelt]
        start = np.concatenate([[0], np.cumsum(width)])
        out = np.zeros(start[-1], dtype=np.int32)
        good = ids >= 0
        out[start[:-1][good]] = ids[good]
        for i, x in zip(bad.tolist(), spelt, strict=True):
            out[start[i] : start[i] + len(x)] = x
        return out, start[offsets]

    def _learn(self, words: list[str]) -> None:
        plain = [w for w in words if SPACE * 2 not in w and len(w) <= LONG_WORD]
        for w in words:
            if SPACE * 2 not in w and len(w) > LONG_WORD:
                self._add([w], row := self._encode_long(w), np.array([0, len(row)]))
        runs = [w for w in words if SPACE * 2 in w]
        while plain:
            size = k = 0
            while k < len(plain) and size < MATCH_CHARS:
                size += len(plain[k]) + 1
                k += 1
            self._add(plain[:k], *self._encode_new(plain[:k]))
            plain = plain[k:]
        if runs:  # pieces of repeated spaces share one rank, so their order of merging decides
            behind, rows = self._behind_spaces([w.lstrip(SPACE) for w in runs]), []
            for w in runs:
                word = w.lstrip(SPACE)
                row = self._merge_runs(w[: len(w) - len(word)], word, behind) if SPACE * 2 not in word else self._merge_row(w)
                row = np.array([row], dtype=np.int32).reshape(-1)
                if (row < 0).any():
                    row, _ = self._spell(row, np.array([0, len(row)]))
                rows.append(row)
            self._add(runs, np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])]))

    def _behind_spaces(self, words: list[str]) -> dict[str, np.ndarray]:
        """The ids of one space and each word that is not long, found for MATCH_CHARS letters of them at a time."""
        short, out, k = sorted({w for w in words if w and len(w) <= LONG_WORD and SPACE * 2 not in w}), {}, 0
        while k < len(short):
            begin, size = k, 0
            while k < len(short) and size < MATCH_CHARS:
                size += len(short[k]) + 2
                k += 1
            ids, cuts = self._encode_new([SPACE + w for w in short[begin:k]])
            out |= {w: ids[i:j] for w, i, j in zip(short[begin:k], cuts[:-1], cuts[1:], strict=True)}
        return out

    def _merge_row(self, w: str) -> list[int]:
        return merge_plainly([self._ids.get(c, -ord(c) - 1) for c in w], self._merges)[0]

    def _merge_runs(self, spaces: str, word: str, behind: dict[str, np.ndarray]) -> list[int]:
        """Only the last space can merge with the word; if it does so before the spaces merge, they go without it."""
        if not word:
            return self._merge_spaces(len(spaces))
        out = behind[word] if word in behind else self._encode_long(SPACE + word)
        first = int(out[0])
        whole = out.tolist()
        if first == self._ids[SPACE]:
            return self._merge_spaces(len(spaces)) + whole[1:]
        return self._merge_spaces(len(spaces) - 1) + whole

    def _merge_spaces(self, n: int) -> list[int]:
        return merge_plainly([self._ids[SPACE]] * n, self._merges)[0]

    def _add(self, words: list[str], ids: np.ndarray, offsets: np.ndarray) -> None:
        self._known.update(zip(words, range(len(self._offsets) - 1, len(self._offsets) - 1 + len(words)), strict=True))
        self._flat = np.concatenate([self._flat, ids])
        self._offsets = np.concatenate([self._offsets, self._offsets[-1] + offsets[1:]])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null and empty texts have none."""
        if len(self._known) > REMEMBERED:
            self.forget()
        split = [_chunks(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if new := set().union(*split) - self._known.keys():
            if "\n" in new:  # in no piece, so a word of its own
                new.remove("\n")
                self._add(["\n"], np.array([self._byte[b"\n"]], dtype=np.int32), np.array([0, 1]))
            self._learn(list(new))
        known, out = self._known, []
        for words in split:
            k = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))
            a = self._offsets[k]
            size = self._offsets[k + 1] - a
            ends = np.cumsum(size)
            out.append(self._flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(a - (ends - size), size)])
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: bytes joined, the space that encoding put in front taken off."""
        b = b"".join(map(self._bytes.__getitem__, ids.tolist()))
        return b.decode("utf-8", "replace").replace(SPACE, " ")[1:]

    def n_bytes(self, ids: np.ndarray) -> int:
        return int(self._is_byte[ids].sum())


_encoders: dict[int, Encoder] = {}


def encoder(v: Pieces) -> Encoder:
    """A worker's own encoder, kept from batch to batch."""
    k = hash((v.text, v.unknown))
    if k not in _encoders:
        _encoders[k] = Encoder(v)
    return _encoders[k]


def _in_parts(texts: pd.Series, most: int = PART_CHARS) -> Iterator[list[str | None]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def digest(text: Column, v: Pieces) -> Column:
    """Struct of a text's n_tokens, n_byte_tokens, ids_crc32 (of its ids as 32-bit little-endian numbers) and
    round_trip: whether decoding gives the text back. Null text counts as empty."""

    @F.pandas_udf("n_tokens long, n_byte_tokens long, ids_crc32 long, round_trip boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        e = encoder(v)
        for texts in batches:
            rows = []
            for part in _in_parts(texts):
                for t, ids in zip(part, e.encode(part), strict=True):
                    rows.append((len(ids), e.n_bytes(ids), zlib.crc32(ids.astype("<i4").tobytes()), e.decode(ids) == (t or "").replace(SPACE, " ")))
            yield pd.DataFrame(rows, columns=["n_tokens", "n_byte_tokens", "ids_crc32", "round_trip"])

    return run(text)


def with_token_ids(docs: DataFrame, v: Pieces, text: str = "text") -> DataFrame:
    """docs with token_ids, null for null text, and n_tokens, 0 for it; columns of these names are replaced.

    A batch is worked on and handed back in parts of about PART_CHARS, so a worker never holds the ids of
    a whole batch. Other columns pass through as they are, whatever their names.
    """
    kept = [f for f in docs.schema.fields if f.name not in ("token_ids", "n_tokens")]
    schema = StructType([*kept, StructField("token_ids", ArrayType(IntegerType())), StructField("n_tokens", LongType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(v)
        for b in batches:
            begin = 0
            while begin < len(b):
                texts, size = [], 0
                while begin + len(texts) < len(b) and size < PART_CHARS:
                    texts.append(b.column(text)[begin + len(texts)].as_py())
                    size += len(texts[-1] or "")
                ids = e.encode(texts)
                sizes = np.array([len(x) for x in ids], dtype=np.int64)
                none = pa.array([t is None for t in texts], pa.bool_())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate(ids).astype(np.int32)), mask=none)
                own = b.slice(begin, len(texts))
                yield pa.RecordBatch.from_arrays([*[own.column(f.name) for f in kept], lists, pa.array(sizes)], names)
                begin += len(texts)

    return docs.mapInArrow(run, schema)


def text_of(ids: Column, v: Pieces) -> Column:
    """The text of an array of ids; null for null."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(v)
        for rows in batches:
            yield pd.Series([None if r is None else e.decode(np.asarray(r, dtype=np.int64)) for r in rows], dtype=object)

    return run(ids)

"""Words and word shingles of a batch of texts as 64-bit hashes, in array operations."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of text worked on at once, if no single text is longer.
PART_BYTES = 1_000_000


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    out = []
    for b in (_BASE, _INVERSE):
        p = np.full(n, b, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def mixed(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h + np.uint64((seed * _BASE + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of UTF-8 texts, A to Z lower-cased, and the place of its text."""
    blob = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    gap = (blob == 32) | ((blob >= 9) & (blob <= 13))
    edge = np.diff(np.concatenate([[True], gap]).astype(np.int8))
    start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    low = blob + ((blob >= 65) & (blob <= 90)) * np.uint8(32)
    size = 1 << int(max(len(blob), PART_BYTES) - 1).bit_length()
    up, down = _powers(size)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(low)])])
    h = mixed((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    return h, np.searchsorted(begins, start, "right") - 1


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct n-word shingles of each text, sorted by text and hash, and their texts.

    A text with fewer words has one, its whole sequence; one without words has none.
    """
    h, doc = word_hashes(texts)
    words = np.bincount(doc, minlength=len(texts))
    whole = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :]) if len(doc) >= n else np.zeros(0, dtype=np.int64)
    s = np.full(len(whole), n, dtype=np.uint64)
    for j in range(n):
        s = mixed(s * np.uint64(_BASE) + h[whole + j], j)
    short = np.flatnonzero((words > 0) & (words < n))
    first = np.concatenate([[0], np.cumsum(words)])
    few = []
    for d in short.tolist():
        x = words[d : d + 1].astype(np.uint64)
        for j in range(int(words[d])):
            x = mixed(x * np.uint64(_BASE) + h[first[d] + j : first[d] + j + 1], j)
        few.append(x)
    s, d = np.concatenate([s, *few]), np.concatenate([doc[whole], short])
    order = np.lexsort((s, d))
    s, d = s[order], d[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    return s[new], d[new]


def parts(batch: pa.RecordBatch, text: str) -> Iterator[tuple[slice, list[bytes]]]:
    """Consecutive rows of a batch with their texts in UTF-8 (null: empty), about PART_BYTES at once."""
    begin, size, found = 0, 0, []
    for i, t in enumerate(batch.column(text).to_pylist()):
        found.append((t or "").encode("utf-8", "replace"))
        size += len(found[-1])
        if size >= PART_BYTES:
            yield slice(begin, i + 1), found
            begin, size, found = i + 1, 0, []
    if found:
        yield slice(begin, begin + len(found)), found

"""Lossless WebP (VP8L): a decoder of the whole bit stream format, and writers for it.

Streams are read least significant bit first, prefix codes from their first bit on, by tables on the next
bits of every position. The writer takes the transform that the image's channels need fewest bits after,
refers back where three pixels or more repeat, uses a colour cache where colours come back, and writes
prefix codes of limited length from the symbols' frequencies.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Sequence
from functools import cached_property, lru_cache

import numpy as np

# Fixed values of the format.
SIGNATURE = 0x2F
MAX_SIDE = 16384
LENGTH_CODES = 24
DISTANCE_CODES = 40
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
CACHE_FACTOR = 0x1E35A7BD
#: Pixels near the current one, nearest first, that the first 120 distance codes stand for.
NEIGHBOURS = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, -p[1], p[0] < 0))
#: Bits whose windows are laid out at once.
SEGMENT = 1 << 16
#: Longest code that is read, and that the writer makes for symbols and for code lengths.
LONGEST, LONGEST_MADE, LONGEST_META = 15, 11, 7
#: Fewest pixels that the writer refers back to, and most.
LEAST_COPY, MOST_COPY = 3, 4096
#: Colour cache that the writer uses, and the share of pixels it must serve.
CACHE_BITS, CACHE_SHARE = 6, 0.2
#: Correlation of channels, or of neighbours, from which on the writer tries transforms that use it.
LIKE = 0.3
#: Block size of the writer's predictor and cross-colour images, as a power of two.
TRANSFORM_BITS = 5


class WebPError(ValueError):
    """The bytes are no lossless WebP image, or break off."""


class Bits:
    """Reads bits of a byte string from a position that moves on."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + bytes(9), 0, 8 * len(data)
        self._windows, self._base = memoryview(b""), -1

    def peek(self, n: int) -> int:
        a = self.at >> 3
        return int.from_bytes(self.data[a : a + 9], "little") >> (self.at & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        v = self.peek(n)
        self.at += n
        if self.at > self.end:
            raise WebPError("the stream breaks off")
        return v

    def same(self, a: int, b: int, n: int) -> bool:
        """Whether the n bits from a are those from b."""
        cut = lambda at: int.from_bytes(self.data[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7) & ((1 << n) - 1)
        return b + n <= self.end and cut(a) == cut(b)

    def windows(self) -> tuple[memoryview, int]:
        """The next 15 bits at each of a segment's positions, and the segment's first position; the current one and 64 more are in it."""
        return self.windows_from(self.at if self._base < 0 or not 0 <= self.at - self._base < SEGMENT - 64 else self._base)

    def windows_from(self, at: int) -> tuple[memoryview, int]:
        base = at >> 3 << 3
        if self._base != base:
            a = base >> 3
            raw = np.frombuffer(self.data[a : a + SEGMENT // 8 + 3] + bytes(16), dtype=np.uint8).astype(np.uint32)
            wide = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
            self._windows, self._base = memoryview((wide[:, None] >> _EIGHT & 0x7FFF).astype(np.uint16).reshape(-1)), base
        return self._windows, base


_EIGHT = np.arange(8, dtype=np.uint32)


@lru_cache(16)
def _reversed(n: int) -> np.ndarray:
    """The numbers of n bits with their bits in reverse."""
    out = np.zeros(1, dtype=np.int64)
    for _ in range(n):
        out = np.concatenate([out * 2, out * 2 + 1])
    return out


def _canonical(lengths: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The used symbols in the order of their codes, and where each code begins among the numbers of 15 bits."""
    order = used[lengths[used].astype(np.uint8).argsort(kind="stable")]
    room = 1 << (LONGEST - lengths[order])
    return order, np.cumsum(room) - room


class Code:
    """A prefix code from the lengths of its symbols' codes; one symbol alone takes no bits."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if not len(used):
            used, lengths = np.array([0]), np.array([1])
        self.only = int(used[0]) if len(used) == 1 else None
        self.length = 0 if len(used) == 1 else int(lengths[used].max())
        if len(used) > 1 and (1 << (LONGEST - lengths[used])).sum() != 1 << LONGEST:
            raise WebPError("the prefix code is not complete")
        self._lengths, self._used = lengths, used

    @cached_property
    def array(self) -> np.ndarray:
        """For every run of `length` bits, 16 times the symbol whose code it begins with, plus that code's length."""
        if self.only is not None:
            return np.array([self.only << 4], dtype=np.int32)
        order, _ = _canonical(self._lengths, self._used)
        n = self._lengths[order]
        return np.repeat((order << 4 | n).astype(np.int32), 1 << (self.length - n))[_reversed(self.length)]

    @cached_property
    def table(self) -> list[int]:
        """array as a list."""
        return self.array.tolist()

    def read(self, bits: Bits) -> int:
        if not self.length:
            return self.only
        v = self.table[bits.peek(self.length)]
        bits.at += v & 15
        if bits.at > bits.end:
            raise WebPError("the stream breaks off")
        return v >> 4


def _small_table(lengths: list[int]) -> list[int]:
    """Code.table of a code of few symbols, made without arrays."""
    used = [k for k, n in enumerate(lengths) if n]
    if len(used) < 2:
        return [used[0] << 4 if used else 0]
    longest, at = max(lengths), 0
    out, back = [0] * (1 << longest), _reversed_list(longest)
    for n, k in sorted((lengths[k], k) for k in used):
        end = at + (1 << (longest - n))
        if end > len(out):
            raise WebPError("the prefix code is not complete")
        for i in range(at, end):
            out[back[i]] = k << 4 | n
        at = end
    if at != len(out):
        raise WebPError("the prefix code is not complete")
    return out


@lru_cache(16)
def _reversed_list(n: int) -> list[int]:
    return _reversed(n).tolist()


def _read_code(bits: Bits, alphabet: int) -> Code:
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths = np.zeros(max(alphabet, 256), dtype=np.int64)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(lengths)
    n = 4 + bits.read(4)
    meta, packed = [0] * 19, bits.read(3 * n)
    for i, k in enumerate(CODE_LENGTH_ORDER[:n]):
        meta[k] = packed >> 3 * i & 7
    table = _small_table(meta)
    left = alphabet if not bits.read(1) else 2 + bits.read(2 + 2 * bits.read(3))
    if left > alphabet:
        raise WebPError("too many code lengths")
    lengths, before, mask = bytearray(), 8, len(table) - 1
    win, base = bits.windows()
    at = bits.at - base
    while len(lengths) < alphabet and left:
        left -= 1
        if at >= SEGMENT - 64 or base + at > bits.end:
            if base + at > bits.end:
                raise WebPError("the stream breaks off")
            win, base = bits.windows_from(base + at)
            at &= 7
        v = table[win[at] & mask]
        at += v & 15
        k = v >> 4
        if k < 16:
            lengths.append(k)
            before = k or before
        elif k == 16:
            lengths += bytes([before]) * (3 + (win[at] & 3))
            at += 2
        elif k == 17:
            lengths += bytes(3 + (win[at] & 7))
            at += 3
        else:
            lengths += bytes(11 + (win[at] & 127))
            at += 7
    bits.at = base + at
    if len(lengths) > alphabet or bits.at > bits.end:
        raise WebPError("too many code lengths, or the stream breaks off")
    return Code(np.frombuffer(bytes(lengths), dtype=np.uint8).astype(np.int64))


def _prefix_value(bits: Bits, code: int) -> int:
    if code < 4:
        return code + 1
    extra = (code - 2) >> 1
    return ((2 + (code & 1)) << extra) + bits.read(extra) + 1


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = NEIGHBOURS[code - 1]
    return max(1, x + y * width)


def _read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """Pixels as ARGB numbers in rows. Only the main image may have several code groups."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise WebPError("the colour cache is too large")
    groups, group_of, block = 1, None, 0
    if main and bits.read(1):
        block = bits.read(3) + 2
        across = -(-width // (1 << block))
        meta = _read_image(bits, across, -(-height // (1 << block)), False)
        group_of = ((meta >> 8) & 0xFFFF).astype(np.int64).reshape(-1, across)
        groups = int(group_of.max()) + 1
    green = 256 + LENGTH_CODES + ((1 << cache_bits) if cache_bits else 0)
    codes = []
    for _ in range(groups):
        found = [_read_code(bits, green)]
        start = bits.at
        found.append(_read_code(bits, 256))
        for _ in range(2):
            size = bits.at - start
            if bits.same(start, bits.at, size):  # the bits of the code before once more
                start, bits.at = bits.at, bits.at + size
                found.append(found[-1])
            else:
                start = bits.at
                found.append(_read_code(bits, 256))
        codes.append([*found, _read_code(bits, DISTANCE_CODES)])
    if groups == 1:
        return _read_pixels(bits, codes[0], width, width * height, cache_bits)
    n, out = width * height, []
    cache, cached = [0] * (1 << cache_bits), 0
    while len(out) < n:
        i = len(out)
        g = codes[int(group_of[i // width >> block, i % width >> block])]
        s = g[0].read(bits)
        if s < 256:
            out.append(s << 8 | g[1].read(bits) << 16 | g[2].read(bits) | g[3].read(bits) << 24)
        elif s < 256 + LENGTH_CODES:
            out += _copied(bits, s, g[4], out, width, n)
        else:
            cached = _remember(cache, out, cached, cache_bits)
            out.append(cache[s - 256 - LENGTH_CODES])
    return np.array(out, dtype=np.uint32)


def _copied(bits: Bits, s: int, code: Code, out: list[int], width: int, n: int) -> list[int]:
    """The pixels that a length symbol and the distance behind it refer back to."""
    size = _prefix_value(bits, s - 256)
    return _copy(out, size, _distance(_prefix_value(bits, code.read(bits)), width), n)


def _copy(out: list[int], size: int, back: int, n: int) -> list[int]:
    i = len(out)
    if back > i or i + size > n:
        raise WebPError("a reference leaves the image")
    return out[i - back : i - back + size] if back >= size else (out[i - back :] * (size // back + 1))[:size]


def _remember(cache: list[int], out: list[int], cached: int, cache_bits: int) -> int:
    """Put the pixels from `cached` on in the colour cache; returns how many are in it then."""
    shift = 32 - cache_bits
    for p in out[cached:]:
        cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> shift] = p
    return len(out)


def _read_pixels(bits: Bits, codes: list[Code], width: int, n: int, cache_bits: int) -> np.ndarray:
    """n pixels of one code group.

    In a segment the symbols at all positions are looked up at once, and with them where the pixel behind
    one that began there begins; then the pixels are walked through, and the values of all taken together.
    """
    parts, out = [], []  # pixels as arrays; as a list from the first segment on that refers back or has cached ones
    cache, cached, left = [0] * (1 << cache_bits), 0, n
    win, base = bits.windows()
    at = bits.at - base
    while left > 0:
        stop = min(SEGMENT - 64, bits.end - base + 1)
        if at >= stop:  # near the end of a segment, or beyond it
            if base + at > bits.end:
                raise WebPError("the stream breaks off")
            win, base = bits.windows_from(base + at)
            at &= 7
            stop = min(SEGMENT - 64, bits.end - base + 1)
        begin, need = at, at + min(stop - at, 4 * LONGEST * left)
        w = np.frombuffer(win, dtype=np.uint16)[begin : need + 8 * LONGEST]
        found = {id(c): c.array.take(w & ((1 << c.length) - 1)) for c in codes[:4]}
        here = np.arange(len(w))
        over = {k: here + (v & 15) for k, v in found.items()}
        green, (red, blue, alpha) = found[id(codes[0])], (over[id(c)] for c in codes[1:4])
        behind = over[id(codes[0])][: need - begin + 4 * LONGEST]
        place = alpha.take(blue.take(red.take(behind, mode="clip"), mode="clip"), mode="clip")
        kind = green[: len(place)]
        if kind.max() >= 256 << 4:
            place = np.where(kind < 256 << 4, place, np.where(kind < (256 + LENGTH_CODES) << 4, -1, behind))
        size = need - begin
        place[size:] = -2  # there the walk ends
        after, steps, events, i = memoryview(place), [], [], 0
        put = steps.append
        while left > 0:
            first = len(steps)
            for _ in range(left):
                k = after[i]
                if k < 0:
                    break
                put(i)
                i = k
            left -= len(steps) - first
            if left <= 0 or after[i] == -2:
                break
            v = int(green[i])
            bits.at = base + begin + i + (v & 15)
            length = _prefix_value(bits, (v >> 4) - 256)
            events.append((len(steps), length, _distance(_prefix_value(bits, codes[4].read(bits)), width)))
            put(i)
            i = bits.at - base - begin
            left -= length
            if i >= size:
                break
        at = begin + i
        steps = np.array(steps, dtype=np.int64)
        symbol = green.take(steps) >> 4
        p = symbol & 255
        p <<= 8
        q = behind.take(steps)
        for c, jump, shift in zip(codes[1:4], (red, blue, alpha), (16, 0, 24), strict=True):
            p |= found[id(c)].take(q, mode="clip") >> 4 << shift
            q = jump.take(q, mode="clip")
        p = p.view(np.uint32)
        special = np.flatnonzero(symbol >= 256).tolist()
        if not special and not out:
            parts.append(p)
            continue
        if parts:
            out, parts = np.concatenate(parts).tolist(), []
        far, values, done = {k: rest for k, *rest in events}, p.tolist(), 0
        for k in special:
            out += values[done:k]
            done = k + 1
            if k in far:
                out += _copy(out, *far[k], n)
            else:
                cached = _remember(cache, out, cached, cache_bits)
                out.append(cache[int(symbol[k]) - 256 - LENGTH_CODES])
        out += values[done:]
    bits.at = base + at
    if bits.at > bits.end:
        raise WebPError("the stream breaks off")
    return np.concatenate(parts) if parts else np.array(out, dtype=np.uint32)


def _channels(p: np.ndarray) -> np.ndarray:
    """B, G, R, A bytes of ARGB numbers, along a last axis."""
    return np.ascontiguousarray(p, dtype="<u4").view(np.uint8).reshape(*p.shape, 4)


def predict(mode: int, left, top, right, corner):
    """The predicted channels from the four neighbours' (above right and above left last), as integer arrays."""
    mean = lambda x, y: (x + y) >> 1
    if mode == 11:
        over = np.abs(top - corner).sum(-1, keepdims=True) < np.abs(left - corner).sum(-1, keepdims=True)
        return np.where(over, left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        m = mean(left, top)
        half = m - corner
        return np.clip(m + np.sign(half) * (np.abs(half) >> 1), 0, 255)
    return (
        lambda: np.broadcast_to(np.array([0, 0, 0, 255]), left.shape), lambda: left, lambda: top, lambda: right, lambda: corner,
        lambda: mean(mean(left, right), top), lambda: mean(left, corner), lambda: mean(left, top), lambda: mean(corner, top),
        lambda: mean(top, right), lambda: mean(mean(left, corner), mean(top, right)),
    )[mode if mode < 11 else 0]()


def _neighbours(c: np.ndarray) -> tuple[np.ndarray, ...]:
    """left, top, above right, above left of every pixel of rows of channels; above right wraps to the row's own start."""
    flat = c.reshape(-1, c.shape[-1])
    w = c.shape[1]
    shift = lambda k: np.concatenate([np.zeros((k, flat.shape[1]), flat.dtype), flat[:-k]])[: len(flat)].reshape(c.shape) if k else c
    return shift(1), shift(w), shift(w - 1) if w > 1 else c, shift(w + 1)


def _modes(image: np.ndarray, size: int, height: int, width: int) -> np.ndarray:
    """A transform's block values spread over the pixels."""
    return np.repeat(np.repeat(image, 1 << size, 0), 1 << size, 1)[:height, :width]


def _undo_predictor(c: np.ndarray, modes: np.ndarray) -> np.ndarray:
    h, w = c.shape[:2]
    out = c.copy()
    out[0, 0, 3] = (int(out[0, 0, 3]) + 255) & 255
    out[0] = np.cumsum(out[0], axis=0, dtype=np.uint8)
    if h == 1:
        return out
    inner = np.unique(modes[1:, 1:])
    if len(inner) <= 1 and (not len(inner) or inner[0] == 2):
        return np.cumsum(out, axis=0, dtype=np.uint8)
    out[:, 0] = np.cumsum(out[:, 0], axis=0, dtype=np.uint8)
    out = out.astype(np.int64)
    for d in range(3, w + 2 * h - 2):  # pixels with x + 2 y = d need only those with less
        y = np.arange(max(1, (d - w + 2) // 2), min(h - 1, (d - 1) // 2) + 1)
        x = d - 2 * y
        last = x == w - 1
        near = out[y, x - 1], out[y - 1, x], out[y - ~last, np.where(last, 0, x + 1)], out[y - 1, x - 1]
        m = modes[y, x]
        for mode in np.unique(m).tolist():
            own = m == mode
            out[y[own], x[own]] = (out[y[own], x[own]] + predict(mode, *[v[own] for v in near])) & 255
    return out.astype(np.uint8)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint8).view(np.int8).astype(np.int64)


def _cross(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    return _signed(t) * _signed(c) >> 5


def decode(data: bytes) -> np.ndarray:
    """Pixels of a lossless WebP file as rows of R, G, B, A bytes. Raises WebPError for anything else."""
    if len(data) < 25 or data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != SIGNATURE:
        raise WebPError("no lossless WebP file")
    bits = Bits(data[21 : 20 + struct.unpack("<I", data[16:20])[0]])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise WebPError("unknown version")
    undo, w = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            size = bits.read(3) + 2
            bw, bh = -(-w // (1 << size)), -(-height // (1 << size))
            undo.append((kind, size, _read_image(bits, bw, bh, False).reshape(bh, bw), w))
        elif kind == SUBTRACT_GREEN:
            undo.append((kind, 0, None, w))
        else:
            n = bits.read(8) + 1
            colours = np.cumsum(_channels(_read_image(bits, n, 1, False)), axis=0, dtype=np.uint8)
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((kind, pack, colours, w))
            w = -(-w // (1 << pack))
    c = _channels(_read_image(bits, w, height, True).reshape(height, w)).copy()
    for kind, size, image, w in reversed(undo):
        if kind == PREDICTOR:
            c = _undo_predictor(c, _modes((image >> 8) & 15, size, height, w))
        elif kind == CROSS_COLOUR:
            t = _channels(_modes(image, size, height, w))
            red = (c[..., 2] + _cross(t[..., 0], c[..., 1])) & 255
            blue = c[..., 0] + _cross(t[..., 1], c[..., 1]) + _cross(t[..., 2], red)
            c[..., 2], c[..., 0] = red, blue & 255
        elif kind == SUBTRACT_GREEN:
            c[..., 0] += c[..., 1]
            c[..., 2] += c[..., 1]
        else:
            index, wide = c[..., 1], 8 >> size
            if size:
                index = np.stack([index >> (k * wide) & ((1 << wide) - 1) for k in range(1 << size)], axis=-1).reshape(height, -1)[:, :w]
            table = np.zeros((256, 4), dtype=np.uint8)
            table[: len(image)] = image
            c = table[index]
    return c[..., [2, 1, 0, 3]]


class Writer:
    """Collects bits, least significant first."""

    def __init__(self):
        self._value, self._n = 0, 0

    def put(self, value: int, n: int) -> None:
        self._value |= value << self._n
        self._n += n

    def append(self, other: Writer) -> None:
        self.put(other._value, other._n)

    def row(self, values: np.ndarray, n: np.ndarray) -> None:
        """Put values of up to 31 bits, n[i] bits of values[i]."""
        at = np.cumsum(n) - n + (self._n & 31)
        wide = values << (at & 31)
        words = int(n.sum() + (self._n & 31) + 63) >> 5
        # bits of different values never meet, so sums put them together, exactly in a double
        low = np.bincount(at >> 5, wide & 0xFFFFFFFF, minlength=words) + np.bincount((at >> 5) + 1, wide >> 32, minlength=words)[:words]
        self._value |= int.from_bytes(low.astype("<u4").tobytes(), "little") << (self._n & ~31)
        self._n += int(n.sum())

    def bytes(self) -> bytes:
        return self._value.to_bytes(-(-self._n // 8), "little")


def file_of(stream: bytes, more: Iterable[tuple[bytes, bytes]] = ()) -> bytes:
    """A RIFF file with a VP8L chunk and further chunks (name, data), which readers pass over."""
    body = b"WEBP"
    for name, data in [(b"VP8L", stream), *more]:
        body += name + struct.pack("<I", len(data)) + data + bytes(len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def put_header(w: Writer, width: int, height: int) -> None:
    w.put(SIGNATURE, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 1)
    w.put(0, 3)


def code_lengths(freq: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of a prefix code for the symbols with a frequency, none above the limit; 1 for a symbol alone."""
    used = np.flatnonzero(freq)
    out = np.zeros(len(freq), dtype=np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    weight = freq[used].astype(np.int64)
    while True:
        order = np.argsort(weight, kind="stable")
        leaves, n = weight[order].tolist(), len(used)
        leaves += [1 << 62] * 2  # behind the last one
        nodes, parent, i, j = [1 << 62] * (n + 1), [0] * (2 * n - 1), 0, 0
        for k in range(n - 1):
            if leaves[i] <= nodes[j]:
                total, parent[i], i = leaves[i], n + k, i + 1
            else:
                total, parent[n + j], j = nodes[j], n + k, j + 1
            if leaves[i] <= nodes[j] and i < n:
                total, parent[i], i = total + leaves[i], n + k, i + 1
            else:
                total, parent[n + j], j = total + nodes[j], n + k, j + 1
            nodes[k] = total
        depth = [0] * (2 * n - 1)
        for k, up in zip(range(2 * n - 3, -1, -1), parent[-2::-1]):
            depth[k] = depth[up] + 1
        if max(depth[:n]) <= limit:
            out[used[order]] = depth[:n]
            return out
        weight = weight // 2 + 1


def _made(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bits of each symbol's code, first bit lowest, and how many there are; none for a symbol alone."""
    used = np.flatnonzero(lengths)
    bits, n = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    if len(used) > 1:
        order, start = _canonical(lengths, used)
        bits[order], n[order] = _reversed(LONGEST)[start], lengths[order]
    return bits, n


def _put_code(w: Writer, freq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Write the code for symbols of these frequencies; returns what _made() does."""
    used = np.flatnonzero(freq)
    if len(used) <= 2 and (not len(used) or used[-1] < 256):
        first = int(used[0]) if len(used) else 0
        w.put(1 | (len(used) == 2) << 1 | (first > 1) << 2, 3)
        w.put(first, 8 if first > 1 else 1)
        if len(used) == 2:
            w.put(int(used[1]), 8)
        return _made((freq > 0).astype(np.int64))
    lengths = code_lengths(freq, LONGEST_MADE)
    tokens: list[tuple[int, int, int]] = []  # symbol, extra bits, how many
    edges = [*(np.flatnonzero(lengths[1:] != lengths[:-1]) + 1).tolist(), len(lengths)]
    a, runs = 0, lengths[[0, *edges[:-1]]].tolist()
    for x, b in zip(runs, edges, strict=True):
        run, a = b - a, b
        if x:
            tokens.append((x, 0, 0))
            run -= 1
        if not run:
            continue
        while run >= (3 if x else 11):
            k = min(run, 6 if x else 138)
            tokens.append((16, k - 3, 2) if x else (18, k - 11, 7))
            run -= k
        if not x and run >= 3:
            tokens.append((17, run - 3, 3))
            run = 0
        tokens += [(x, 0, 0)] * run
    times = [0] * 19
    for t, _, _ in tokens:
        times[t] += 1
    meta = code_lengths(np.array(times), LONGEST_META)
    plain = meta.tolist()
    n = max(4, max(i for i, k in enumerate(CODE_LENGTH_ORDER) if plain[k]) + 1)
    value, at = (n - 4) << 1, 5
    for k in CODE_LENGTH_ORDER[:n]:
        value |= plain[k] << at
        at += 3
    at += 1
    bits, size = (x.tolist() for x in _made(meta))
    for t, extra, k in tokens:
        m = size[t]
        value |= (bits[t] | extra << m) << at
        at += m + k
    w.put(value, at)
    return _made(lengths)


def _prefix(value: int) -> tuple[int, int, int]:
    """Code, extra bits and their number for a length or distance."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    top = v.bit_length() - 1
    return 2 * top + (v >> (top - 1) & 1), v & ((1 << (top - 1)) - 1), top - 1


@lru_cache(64)
def _near_codes(width: int) -> dict[int, int]:
    """The distance codes of near pixels by how far back they are in an image of this width."""
    return {max(1, x + y * width): k + 1 for k, (x, y) in reversed(list(enumerate(NEIGHBOURS)))}


def copies(p: np.ndarray) -> list[tuple[int, int, int]]:
    """start, length, distance of runs of LEAST_COPY pixels or more that stand earlier, from left to right, the nearest place first."""
    if len(p) <= LEAST_COPY:
        return []
    q = p.astype(np.uint64)
    mixed = (q[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (q[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (q[2:] * np.uint64(0x165667B19E3779F9))
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    if not same.any():
        return []
    before = np.full(len(mixed), -1, dtype=np.int64)
    before[order[1:][same]] = order[:-1][same]
    found, free = [], 0
    for i in np.flatnonzero(before >= 0).tolist():
        if i < free:
            continue
        j, n, step = int(before[i]), 0, 64
        while n < MOST_COPY:
            k = min(step, MOST_COPY - n, len(p) - i - n)
            if k <= 0:
                break
            unlike = np.flatnonzero(p[i + n : i + n + k] != p[j + n : j + n + k])
            if len(unlike):
                n += int(unlike[0])
                break
            n, step = n + k, 2 * step
        if n >= LEAST_COPY:
            found.append((i, n, i - j))
            free = i + n
    return found


def _put_image(w: Writer, p: np.ndarray, width: int, main: bool, cache: bool | None = None, refer: bool = True, block: int = 0, pooled: bool = False) -> None:
    """Write ARGB numbers in rows: cache flag, group image of the main image, codes, symbols.

    cache None uses one where it serves CACHE_SHARE of the pixels. block, a power of two from 2 on, gives
    each block of the main image one of two code groups in turn; 0 has one group for all. pooled gives red, blue and alpha one
    code, which is made and read faster.
    """
    n, refs = len(p), copies(p) if refer else []
    hit, slot = np.zeros(n, dtype=bool), np.zeros(n, dtype=np.int64)
    if cache is not False:
        slot = (p.astype(np.int64) * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - CACHE_BITS)
        order = np.argsort(slot, kind="stable")
        hit[order[1:]] = (slot[order[1:]] == slot[order[:-1]]) & (p[order[1:]] == p[order[:-1]])
        cache = bool(hit.any()) if cache else hit.sum() > CACHE_SHARE * n
        if not cache:
            hit[:] = False
    w.put(1 | CACHE_BITS << 1 if cache else 0, 5 if cache else 1)
    group = np.zeros(n, dtype=np.int64)
    if main:
        w.put(int(block > 0), 1)
        if block:
            w.put(block - 2, 3)
            across, down = -(-width // (1 << block)), -(-(n // width) // (1 << block))
            meta = np.arange(across * down) % 2 << 8
            _put_image(w, meta.astype(np.uint32), across, False, False)
            at = np.arange(n)
            group = meta[(at // width >> block) * across + (at % width >> block)] >> 8
    inside = np.zeros(n, dtype=bool)
    for i, size, _ in refs:
        inside[i + 1 : i + size] = True
    at = np.flatnonzero(~inside)
    c = _channels(p[at]).astype(np.int64)
    value, bits = np.zeros((len(at), 4), dtype=np.int64), np.zeros((len(at), 4), dtype=np.int64)
    green, kind = np.where(hit[at], 256 + LENGTH_CODES + slot[at], c[:, 1]), hit[at].astype(np.int64)
    where, far = np.searchsorted(at, [i for i, *_ in refs]), []
    near = _near_codes(width) if refs else {}
    for k, (_, size, back) in zip(where.tolist(), refs, strict=True):
        code, extra, m = _prefix(size)
        green[k], kind[k], value[k, 1], bits[k, 1] = 256 + code, 2, extra, m
        code, extra, m = _prefix(near.get(back, back + 120))
        far.append(code)
        value[k, 3], bits[k, 3] = extra, m
    far, groups = np.array(far, dtype=np.int64), group[at]
    for g in range(1 + int(group.max(initial=0))):
        own = groups == g if block else slice(None)
        literal = (groups == g) & (kind == 0) if block or kind.any() else slice(None)
        refer_back = groups[where] == g
        count = lambda x, size: np.bincount(x, minlength=size)
        code, m = _put_code(w, count(green[own], 256 + LENGTH_CODES + ((1 << CACHE_BITS) if cache else 0)))
        value[own, 0], bits[own, 0] = code[green[own]], m[green[own]]
        rest = c[literal][:, [2, 0, 3]]
        if pooled:  # one code for red, blue and alpha, written three times
            freq = count(rest.reshape(-1), 256)
            sub = Writer()
            code, m = _put_code(sub, freq)
            for _ in range(3):
                w.append(sub)
            value[literal, 1:], bits[literal, 1:] = code.take(rest), m.take(rest)
        else:
            for k, (code, m) in enumerate([_put_code(w, count(rest[:, k], 256)) for k in range(3)]):
                value[literal, k + 1], bits[literal, k + 1] = code[rest[:, k]], m[rest[:, k]]
        code, m = _put_code(w, count(far[refer_back], DISTANCE_CODES))
        if len(where):
            value[where[refer_back], 2], bits[where[refer_back], 2] = code[far[refer_back]], m[far[refer_back]]
    w.row(value.reshape(-1), bits.reshape(-1))


def _costs(c: np.ndarray) -> list[float]:
    """Bits of the channels' values by their own frequencies, for each of several images of one size."""
    k = len(c)
    flat = c.reshape(k, -1, 4).astype(np.int64) + np.arange(0, 1024 * k, 256).reshape(k, 1, 4)
    n = np.bincount(flat.reshape(-1), minlength=1024 * k).reshape(k, -1)
    return (c[0].size * np.log2(c[0].size / 4) - (n * np.log2(np.maximum(n, 1))).sum(1)).tolist()


def _minus_green(c: np.ndarray) -> np.ndarray:
    out = c.copy()
    out[..., 0] -= c[..., 1]
    out[..., 2] -= c[..., 1]
    return out


def _residuals(c: np.ndarray, modes: np.ndarray) -> np.ndarray:
    """What is left of each pixel after prediction by its mode; the first row and column have theirs fixed."""
    x = c.astype(np.int64)
    near = _neighbours(x)
    modes = modes.copy()
    modes[:, 0], modes[0], modes[0, 0] = 2, 1, 0
    out = x.copy()
    for mode in np.unique(modes).tolist():
        own = modes == mode
        out[own] = x[own] - predict(mode, *[v[own] for v in near])
    return (out & 255).astype(np.uint8)


def _fit_cross(c: np.ndarray) -> np.ndarray:
    """Best whole multipliers, in 32nds, of green on red, green on blue and red on blue, as a pixel of the transform."""
    b, g, r = (_signed(c[..., k].reshape(-1)).astype(float) for k in range(3))
    slope = lambda x, y: int(np.clip(np.round(32 * (x * y).sum() / max((x * x).sum(), 1)), -128, 127))
    t = slope(g, r), slope(g, b)
    return np.array([t[0], t[1], 0, 0]).astype(np.int8).view(np.uint8)


def _without_cross(c: np.ndarray, t: np.ndarray) -> np.ndarray:
    out = c.astype(np.int64)
    red, blue = c[..., 2] - _cross(t[..., 0], c[..., 1]), c[..., 0] - _cross(t[..., 1], c[..., 1]) - _cross(t[..., 2], c[..., 2])
    out[..., 2], out[..., 0] = red, blue
    return (out & 255).astype(np.uint8)


def _numbers(c: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(c, dtype=np.uint8).reshape(-1, 4).view("<u4")[:, 0]


def choose(c: np.ndarray) -> int | None:
    """The transform after which the channels cost fewest bits, prediction from the left; None for none.

    Only what can help is tried: green and cross-colour where channels go together, prediction where
    neighbours do.
    """
    h, w = c.shape[:2]
    x = c.reshape(-1, 4).astype(np.float32)
    x -= x.mean(0)
    both = x.T @ x
    var = np.maximum(np.diag(both), 1)
    like = np.abs(both) / np.sqrt(var[:, None] * var[None, :])
    kinds, tried = [None], [c]
    if max(like[0, 1], like[1, 2], like[0, 2]) > LIKE:
        kinds += [SUBTRACT_GREEN, CROSS_COLOUR]
        tried += [_minus_green(c), _without_cross(c, np.broadcast_to(_fit_cross(c), c.shape))]
    if len(x) > 1 and (np.einsum("ij,ij->j", x[1:], x[:-1]) / var).max() > LIKE:
        kinds.append(PREDICTOR)
        tried.append(c - np.concatenate([np.zeros((h, 1, 4), dtype=np.uint8), c[:, :-1]], axis=1))
    found = np.sort(_numbers(c))
    colours = 1 + int(np.count_nonzero(found[1:] != found[:-1]))
    if len(kinds) == 1 and colours > 256:
        return None
    costs = dict(zip(kinds, _costs(np.stack(tried)), strict=True))
    if colours <= 256:
        costs[PALETTE] = h * w * np.log2(colours) + 24 * colours
    return min(costs, key=lambda k: costs[k] + (60 if k in (PREDICTOR, CROSS_COLOUR) else 0))


def encode(pixels: np.ndarray, transforms: Sequence[int] | None = None, cache: bool | None = None, refer: bool = True, block: int = 0, modes: np.ndarray | None = None, cross: np.ndarray | None = None, pooled: bool = False) -> bytes:
    """A VP8L stream of rows of R, G, B, A bytes.

    transforms, in the order they are written, is chosen by choose() for None; a palette comes last. cache,
    refer, block and pooled are those of _put_image(). modes gives the predictor (all left for None) and cross the
    multipliers (fitted for None) of blocks of 2 ** TRANSFORM_BITS pixels a side.
    """
    c = np.ascontiguousarray(pixels[..., [2, 1, 0, 3]])
    h, width = c.shape[:2]
    across, down = -(-width // (1 << TRANSFORM_BITS)), -(-h // (1 << TRANSFORM_BITS))
    w = Writer()
    put_header(w, width, h)
    if transforms is None:
        best = choose(c)
        transforms = [] if best is None else [best]
    for kind in transforms:
        w.put(1 | kind << 1, 3)
        if kind == PREDICTOR:
            m = np.full((down, across), 1) if modes is None else modes
            w.put(TRANSFORM_BITS - 2, 3)
            _put_image(w, (m.reshape(-1) << 8 | 0xFF000000).astype(np.uint32), across, False, False)
            c = _residuals(c, _modes(m, TRANSFORM_BITS, h, width))
        elif kind == CROSS_COLOUR:
            t = np.broadcast_to(_fit_cross(c), (down, across, 4)) if cross is None else cross
            w.put(TRANSFORM_BITS - 2, 3)
            _put_image(w, _numbers(t), across, False, False)
            c = _without_cross(c, _modes(t, TRANSFORM_BITS, h, width))
        elif kind == SUBTRACT_GREEN:
            c = _minus_green(c)
        else:
            colours, index = np.unique(_numbers(c), return_inverse=True)
            table = _channels(colours.astype("<u4"))
            w.put(len(colours) - 1, 8)
            _put_image(w, _numbers(np.diff(table, axis=0, prepend=np.zeros((1, 4), dtype=np.uint8))), len(colours), False, False)
            pack = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
            wide, index = 8 >> pack, index.reshape(h, width)
            index = np.pad(index, ((0, 0), (0, -width % (1 << pack))))
            green = sum(index[:, k :: 1 << pack] << (k * wide) for k in range(1 << pack))
            width = green.shape[1]
            c = np.zeros((h, width, 4), dtype=np.uint8)
            c[..., 1], c[..., 3] = green, 255
    w.put(0, 1)
    _put_image(w, _numbers(c), width, True, cache, refer, block, pooled)
    return w.bytes()

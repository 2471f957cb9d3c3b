"""Lossless images: every transform, prefix codes, references, cache and groups, and what op8_media returns."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tidelag.llm import media, queries, webp

P, X, G, I = webp.PREDICTOR, webp.CROSS_COLOUR, webp.SUBTRACT_GREEN, webp.PALETTE  # noqa: E741


def picture(r, kind, h, w):
    if kind == "noise":
        return r.integers(0, 256, (h, w, 4)).astype(np.uint8)
    if kind == "smooth":
        return (np.cumsum(r.integers(-2, 3, (h, w, 4)), axis=1) & 255).astype(np.uint8)
    if kind == "rows":
        return np.repeat(r.integers(0, 256, (1, w, 4)), h, 0).astype(np.uint8)
    return (r.integers(0, int(kind), (h, w, 1)) * np.array([3, 5, 7, 1])).astype(np.uint8)


@pytest.mark.parametrize("transforms", [[], [P], [X], [G], [I], [P, X, G], [G, P], [X, G, P], None])
@pytest.mark.parametrize("size", [(1, 1), (1, 33), (37, 1), (2, 2), (33, 65), (40, 16)])
def test_what_is_written_reads_back(transforms, size):
    r = np.random.default_rng(abs(hash((str(transforms), size))) % 2**32)
    h, w = size
    for kind in ("2", "3", "12", "200") if transforms == [I] else ("noise", "smooth", "rows", "3"):
        px = picture(r, kind, h, w)
        across, down = -(-w // 32), -(-h // 32)
        for cache, refer, block, pooled in ((None, True, 0, True), (True, True, 2, False), (False, False, 3, True), (True, False, 0, False)):
            stream = webp.encode(px, transforms, cache, refer, block, r.integers(0, 14, (down, across)), r.integers(0, 256, (down, across, 4)).astype(np.uint8), pooled)
            assert np.array_equal(webp.decode(webp.file_of(stream)), px), (kind, cache, refer, block)


@pytest.mark.parametrize("mode", range(14))
def test_every_predictor(mode):
    px = picture(np.random.default_rng(mode), "smooth", 9, 7)
    stream = webp.encode(px, [P], modes=np.array([[mode]]))
    assert np.array_equal(webp.decode(webp.file_of(stream)), px)


def test_a_stream_made_by_hand():
    w = webp.Writer()
    webp.put_header(w, 3, 1)
    w.put(0, 1)  # no transform
    w.put(1, 1), w.put(2, 4)  # a colour cache of four
    w.put(0, 1)  # one group
    lengths = np.zeros(256 + 24 + 4, dtype=np.int64)
    colour = 255 << 24 | 10 << 16 | 20 << 8 | 30
    slot = (webp.CACHE_FACTOR * colour & 0xFFFFFFFF) >> 30
    lengths[[20, 256, 280 + slot]] = 1, 2, 2  # codes 0, 10, 11
    w.put(0, 1), w.put(8, 4)  # twelve lengths of the code of lengths, up to that of 5
    for k in webp.CODE_LENGTH_ORDER[:12]:
        w.put({0: 1, 1: 2, 2: 2}.get(k, 0), 3)  # codes 0, 10, 11
    w.put(0, 1)
    for x in lengths.tolist():
        w.put({0: 0b0, 1: 0b01, 2: 0b11}[x], {0: 1, 1: 2, 2: 2}[x])
    for x in (10, 30, 255):  # red, blue and alpha of one symbol
        w.put(0b101, 3), w.put(x, 8)
    w.put(0b001, 3), w.put(1, 1)  # distance symbol 1: the pixel to the left
    w.put(0b0, 1)  # a literal
    w.put(0b11, 2)  # the same from the cache
    w.put(0b01, 2)  # one pixel copied
    assert webp.decode(webp.file_of(w.bytes())).tolist() == [[[10, 20, 30, 255]] * 3]


def test_bad_files_and_long_streams():
    for data in (b"", b"RIFF", webp.file_of(b"\x2f"), webp.file_of(webp.encode(np.zeros((40, 40, 4), dtype=np.uint8))[:4]), webp.file_of(webp.encode(picture(np.random.default_rng(1), "noise", 40, 40))[:900])):
        with pytest.raises(webp.WebPError):
            webp.decode(data)
    r = random.Random(3)
    for payload in (r.randbytes(64 * 9000), b"ab" * 200_000, bytes(64)):
        payload += bytes(-len(payload) % 64)
        data = media.pack(payload)
        assert media.unpack(data)[0] == payload and len(data) < len(payload) + 4000


def test_prefix_codes_keep_their_limit():
    freq = np.array([1, 1] + [2**i for i in range(1, 30)])
    for limit in (7, 11, 15):
        lengths = webp.code_lengths(freq, limit)
        assert lengths.max() <= limit and sum(2.0 ** -int(x) for x in lengths) == 1
    assert webp.code_lengths(np.array([0, 5, 0]), 11).tolist() == [0, 1, 0]


def test_op8_against_plain_arithmetic(spark, tmp_path):
    texts = [None, "", "a", "Übung macht den Meister. " * 40, "x" * 64, "y" * 65, "ab\n" * 50_000, "a", "".join(chr(33 + i % 90) for i in range(7000))]
    spark.createDataFrame([*enumerate(texts), (7, "a")], "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op8_media(spark, str(tmp_path)).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        means = "".join(f"{int(np.mean(x)) if len(x) else 0:02x}" for x in np.array_split(np.frombuffer(payload, dtype=np.uint8), 8))
        want = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == want
        assert r["media_bytes"] == len(media.pack(payload)) and r["media_sha256"] == hashlib.sha256(media.pack(payload)).hexdigest()
        assert len(payload) > 4096 or r["feature"] == means
        if len(raw) > 500:
            assert r["media_bytes"] < 0.95 * len(payload)


def test_what_the_documents_reach(spark):
    reached = Counter()
    for (t,) in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        raw = (t or "").encode()
        px = np.frombuffer(raw + bytes(-len(raw) % 64 if raw else 64), dtype=np.uint8).reshape(-1, 16, 4)
        c = px[..., [2, 1, 0, 3]]
        reached[f"transform {webp.choose(c)}"] += 1
        reached["references"] += bool(webp.copies(webp._numbers(c)))
    assert reached["references"] > 50 and reached["transform None"] > 50 and reached[f"transform {I}"] > 0


def test_small_tables_are_those_of_codes():
    r = np.random.default_rng(4)
    for _ in range(50):
        freq = r.integers(0, 30, 19) * r.integers(0, 2, 19)
        lengths = webp.code_lengths(freq, webp.LONGEST_META)
        assert webp._small_table(lengths.tolist()) == webp.Code(lengths).table
    for lengths in ([1, 2], [1, 1, 1]):
        with pytest.raises(webp.WebPError):
            webp._small_table(lengths)


def test_walks_over_segments_with_references_and_cache():
    r = np.random.default_rng(6)
    for colours in (40, 100_000):
        px = r.integers(0, 256, (colours, 4)).astype(np.uint8)[r.integers(0, colours, 40_000)]
        px[9000:21_000] = px[:12_000]
        px = px.reshape(-1, 16, 4)
        for cache in (True, False):
            stream = webp.encode(px, [], cache)
            assert 8 * len(stream) > 2 * webp.SEGMENT or colours == 40
            assert np.array_equal(webp.decode(webp.file_of(stream)), px)

"""Texts stored as lossless images and read back: a media column with features of what was read."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelag.llm import webp

#: The payload is filled up with zeros to a positive multiple of so many bytes, a row of 16 pixels.
UNIT = 64
_LENGTH = b"PAYL"


def pack(payload: bytes) -> bytes:
    """A lossless WebP file with payload as its samples; a further chunk has the payload's length.

    Rows have 16 pixels, or the multiple that keeps the height within the format's limit.
    """
    rows = max(1, len(payload) // UNIT)
    wide = -(-rows // webp.MAX_SIDE)
    height = -(-rows // wide)
    samples = np.zeros(height * wide * UNIT, dtype=np.uint8)
    samples[: len(payload)] = np.frombuffer(payload, dtype=np.uint8)
    return webp.file_of(webp.encode(samples.reshape(height, -1, 4), pooled=True), [(_LENGTH, struct.pack("<Q", len(payload)))])


def unpack(data: bytes) -> tuple[bytes, np.ndarray]:
    """The payload of a file that pack() made, and its pixels."""
    pixels = webp.decode(data)
    at = 20 + struct.unpack("<I", data[16:20])[0]
    at += at & 1
    if data[at : at + 4] != _LENGTH:
        raise webp.WebPError("the file has no payload length")
    return pixels.tobytes()[: struct.unpack("<Q", data[at + 8 : at + 16])[0]], pixels


def features(pixels: np.ndarray) -> str:
    """The mean sample of each eighth of the image, as hexadecimal."""
    flat = pixels.reshape(-1)
    parts = flat.reshape(8, -1).mean(1).tolist() if len(flat) and not len(flat) % 8 else [x.mean() if len(x) else 0 for x in np.array_split(flat, 8)]
    return "".join(f"{int(x):02x}" for x in parts)


_DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def stored(text: Column, with_media: bool = True) -> Column:
    """Struct of what storing a text as an image gives, and the image file itself as media; null counts as empty.

    n_bytes, payload_bytes, payload_sha256, tail_crc32 (of the last 64 bytes) and feature come from the
    bytes read back. Without with_media the files are made and read, but not returned.
    """

    @F.pandas_udf(_DIGEST + (", media binary" if with_media else ""))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in _DIGEST.split(", ")] + ["media"] * with_media
        for texts in batches:
            rows = []
            for t in texts:
                raw = (t or "").encode("utf-8", "replace")
                media = pack(raw + bytes(-len(raw) % UNIT if raw else UNIT))
                payload, pixels = unpack(media)
                digest = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), features(pixels))
                rows.append((*digest, media) if with_media else digest)
            yield pd.DataFrame(rows, columns=names)

    return run(text)


def pixel_arrays(media: Column) -> Column:
    """Struct of width, height and pixels (array of R, G, B, A samples in rows) of a lossless WebP column.

    Null for null and for bytes that are no lossless WebP image.
    """

    @F.pandas_udf("width int, height int, pixels array<short>")
    def run(files: pd.Series) -> pd.DataFrame:
        rows = []
        for f in files:
            try:
                p = None if f is None else webp.decode(bytes(f))
            except webp.WebPError:
                p = None
            rows.append((None, None, None) if p is None else (p.shape[1], p.shape[0], p.reshape(-1).astype(np.int16)))
        return pd.DataFrame(rows, columns=["width", "height", "pixels"]).astype({"width": "Int32", "height": "Int32"})

    return run(media)

"""Images and masks as pixel rows: PNG (eight bits a channel) and NumPy arrays.

Spark lists and reads the files (``binaryFile``); a file is a tile's, so it is decoded
whole in one task. Other formats need codecs that are not part of this package.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def decode_png(raw: bytes) -> np.ndarray:
    """Rows x columns x channels of an eight-bit PNG without interlacing; palettes are looked up."""
    if not raw.startswith(SIGNATURE):
        raise ValueError("not a PNG")
    at, parts, palette, head = len(SIGNATURE), [], None, None
    while at < len(raw):
        (size,), kind = struct.unpack(">I", raw[at : at + 4]), raw[at + 4 : at + 8]
        body = raw[at + 8 : at + 8 + size]
        at += size + 12
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            parts.append(body)
    if head is None or head[2] != 8 or head[6] != 0 or head[3] not in CHANNELS:
        raise ValueError("only eight-bit PNG without interlacing")
    width, height, step = head[0], head[1], CHANNELS[head[3]]
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, 1 + width * step)
    out = np.zeros((height, width, step), np.int64)
    above = np.zeros((width, step), np.int64)
    for r in range(height):
        how, now = lines[r, 0], lines[r, 1:].reshape(width, step).astype(np.int64)
        if how == 2:
            now = now + above
        elif how == 1:
            now = np.cumsum(now, axis=0)
        elif how > 2:  # each pixel needs the one before it
            left, corner = np.zeros(step, np.int64), np.zeros(step, np.int64)
            for c in range(width):
                up = above[c]
                if how == 3:
                    guess = (left + up) // 2
                else:
                    near = np.abs(np.stack([up - corner, left - corner, left + up - 2 * corner]))
                    guess = np.choose(near.argmin(axis=0), [left, up, corner])
                left, corner = (now[c] + guess) & 255, up
                now[c] = left
        out[r] = above = now & 255
    return (palette[out[:, :, 0]] if head[3] == 3 else out).astype(np.uint8)


def encode_png(pixels: np.ndarray) -> bytes:
    """A PNG of rows x columns (grey) or rows x columns x 3 bytes."""
    pixels = np.asarray(pixels, np.uint8)
    height, width = pixels.shape[:2]
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)], axis=1)
    head = struct.pack(">IIBBBBB", width, height, 8, 0 if pixels.ndim == 2 else 2, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def decode(raw: bytes, mask: bool) -> np.ndarray:
    """Rows x columns x 3, or for a mask rows x columns; grey images have equal channels, alpha goes."""
    if raw[:6] == b"\x93NUMPY":
        got = np.load(io.BytesIO(raw), allow_pickle=False)
    else:
        got = decode_png(raw)
        got = got[:, :, : 3 if got.shape[2] > 2 else 1]
        got = got[:, :, 0] if got.shape[2] == 1 else got
    if mask:
        if got.ndim != 2:
            raise ValueError(f"a mask has two dimensions, not {got.ndim}")
        return got
    return np.repeat(got[:, :, None], 3, axis=2) if got.ndim == 2 else got


def read_pixels(spark: SparkSession, path: str, mask: bool = False) -> DataFrame:
    """(path, r, c, v) of masks, else (path, r, c, red, green, blue), of the files under ``path``."""
    names = ["v"] if mask else ["red", "green", "blue"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = decode(raw.as_py(), mask)
                r, c = np.divmod(np.arange(got.shape[0] * got.shape[1]), got.shape[1])
                flat = got.reshape(len(r), -1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(r)), pa.array(r.astype(np.int32)), pa.array(c.astype(np.int32)), *(pa.array(flat[:, i]) for i in range(len(names)))], names=["path", "r", "c", *names])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, r int, c int, " + ", ".join(f"{n} int" for n in names))

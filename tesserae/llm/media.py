"""Media columns: Netpbm and BMP bytes to numpy arrays, area resizing by integral images, NPY tiles and difference hashes.

Images are (height, width) arrays, or (height, width, 3) for colour, of uint8, or uint16 where Netpbm's maximum is above
255. Each image is handled alone, in batches of bounded size.
"""

from __future__ import annotations

import io
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

WIDTH, TILE = 64, 32
MEDIA = "doc_id long, n_bytes long, media binary"
FEATURES = "doc_id long, n_bytes long, media binary, samples binary, height int, width int, tile binary, dhash string"

_FIELD = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*([^\s#]+)")


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6, plain and raw, with comments in the header."""
    kind, at, head = data[:2], 2, []
    if not re.fullmatch(rb"P[1-6]", kind):
        raise ValueError("not a Netpbm image")
    while len(head) < (2 if kind in (b"P1", b"P4") else 3):
        m = _FIELD.match(data, at)
        if not m:
            raise ValueError("the header ends early")
        head.append(int(m[1]))
        at = m.end()
    width, height, most = [*head, 1][:3]
    depth = 3 if kind in (b"P3", b"P6") else 1
    shape = (height, width, 3) if depth == 3 else (height, width)
    n = height * width * depth
    if kind == b"P1":
        bits = [c - 48 for c in re.sub(rb"#[^\n\r]*", b"", data[at:]) if c in b"01"]
        return (1 - np.array(bits[:n], np.uint8).reshape(shape)) * np.uint8(255)
    if kind in (b"P2", b"P3"):
        numbers = re.sub(rb"#[^\n\r]*", b"", data[at:]).split()[:n]
        return np.array(numbers, np.int64).astype(np.uint16 if most > 255 else np.uint8).reshape(shape)
    at += 1
    if kind == b"P4":
        rows = np.frombuffer(data, np.uint8, height * -(-width // 8), at).reshape(height, -1)
        return (1 - np.unpackbits(rows, axis=1)[:, :width]) * np.uint8(255)
    if most > 255:
        return np.frombuffer(data, ">u2", n, at).astype(np.uint16).reshape(shape)
    return np.frombuffer(data, np.uint8, n, at).reshape(shape)


def encode_netpbm(image: np.ndarray) -> bytes:
    """Raw grey (P5) or colour (P6)."""
    most, raw = (65535, image.astype(">u2")) if image.dtype == np.uint16 else (255, image)
    return b"P%d\n%d %d\n%d\n" % (6 if image.ndim == 3 else 5, image.shape[1], image.shape[0], most) + raw.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits a pixel; a palette of greys gives a grey image."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP image")
    start, header, width, height, _, bits, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if packing not in (0, 3) or bits not in (1, 4, 8, 24, 32):
        raise ValueError(f"BMP of {bits} bits with compression {packing} is not supported")
    line, rows = -(-width * bits // 32) * 4, abs(height)
    raw = np.frombuffer(data, np.uint8, line * rows, start).reshape(rows, line)
    raw = raw if height < 0 else raw[::-1]
    if bits >= 24:
        return np.ascontiguousarray(raw[:, : width * bits // 8].reshape(rows, width, bits // 8)[..., 2::-1])
    if bits == 8:
        index = raw[:, :width]
    elif bits == 4:
        index = np.stack([raw >> 4, raw & 15], 2).reshape(rows, -1)[:, :width]
    else:
        index = np.unpackbits(raw, axis=1)[:, :width]
    colours = struct.unpack_from("<I", data, 46)[0] or 1 << bits
    palette = np.frombuffer(data, np.uint8, 4 * colours, 14 + header).reshape(-1, 4)[:, 2::-1]
    found = palette[index]
    return np.ascontiguousarray(found[..., 0] if (palette == palette[:, :1]).all() else found)


def encode_bmp(image: np.ndarray) -> bytes:
    """8 bits with a grey palette, or 24 bits; rows from the bottom, padded to four bytes."""
    rows, width = image.shape[:2]
    palette = b"" if image.ndim == 3 else np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(-1, 4).tobytes()
    flat = (image[..., ::-1] if image.ndim == 3 else image)[::-1].reshape(rows, -1)
    body = np.pad(flat, ((0, 0), (0, -flat.shape[1] % 4))).astype(np.uint8).tobytes()
    start = 54 + len(palette)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", start + len(body), 0, 0, start, 40, width, rows, 1, 24 if image.ndim == 3 else 8, 0, len(body), 2835, 2835, 0, 0) + palette + body


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over the areas of a height x width grid, as doubles; colours are averaged to grey first.

    The integral image, interpolated at the fractional grid lines, gives the exact integral over any rectangle.
    """
    grey = image.mean(2) if image.ndim == 3 else image.astype(np.float64)
    integral = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1))
    integral[1:, 1:] = grey.cumsum(0).cumsum(1)

    def lines(n: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(parts + 1) * (n / parts)
        low = np.minimum(at.astype(np.int64), n - 1)
        return low, at - low

    (y, fy), (x, fx) = lines(grey.shape[0], height), lines(grey.shape[1], width)
    rows = integral[y] * (1 - fy)[:, None] + integral[y + 1] * fy[:, None]
    grid = rows[:, x] * (1 - fx) + rows[:, x + 1] * fx
    return np.diff(np.diff(grid, axis=0), axis=1) * (height * width / grey.size)


def difference_hash(image: np.ndarray) -> str:
    """64 bits as hex: whether each of 8 x 9 area means is below its right neighbour."""
    small = np.round(area_resize(image, 8, 9), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def tile_of(image: np.ndarray, side: int = TILE) -> bytes:
    """The image resized to side x side, rounded to uint8, as an NPY file."""
    scale = 1 if image.dtype == np.uint8 else 255 / 65535
    return npy(np.clip(np.rint(area_resize(image, side, side) * scale), 0, 255).astype(np.uint8))


def store_payloads(docs: DataFrame, width: int = WIDTH, label: str = "media") -> DataFrame:
    """Write the UTF-8 bytes of each text of docs (doc_id, text), with bytes 0 up to a positive multiple of width, as the
    samples of a grey Netpbm image of that width. Returns the written rows (doc_id, n_bytes, media)."""
    small_batches(docs.sparkSession, 200)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
            images = [np.frombuffer(b.ljust(max(1, -(-len(b) // width)) * width, b"\0"), np.uint8).reshape(-1, width) for b in raw]
            yield pa.record_batch([batch.column(0), pa.array([len(b) for b in raw], pa.int64()), pa.array([encode_netpbm(i) for i in images], pa.binary())], ["doc_id", "n_bytes", "media"])

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, MEDIA), label)


def media_features(media: DataFrame) -> DataFrame:
    """Decode media (doc_id, n_bytes, media): adds samples (row by row), height, width, an NPY tile and a difference hash.

    A null image gives null columns. Equal images give equal values; an empty table gives no rows.
    """
    small_batches(media.sparkSession, 200)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            images = [None if b is None else decode(b) for b in batch.column(2).to_pylist()]
            of = lambda f, kind: pa.array([None if i is None else f(i) for i in images], kind)
            columns = [of(lambda i: i.tobytes(), pa.binary()), of(lambda i: i.shape[0], pa.int32()), of(lambda i: i.shape[1], pa.int32()), of(tile_of, pa.binary()), of(difference_hash, pa.string())]
            yield pa.record_batch([*batch.columns, *columns], [c.split()[0] for c in FEATURES.split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURES)

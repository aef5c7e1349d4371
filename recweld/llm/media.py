"""Media columns: texts as PNG images in binary columns, read back with checks, and a low-frequency cosine hash.

A text's UTF-8 bytes, padded with bytes 255 up to a positive multiple of CELL, are the samples of an 8-bit grey image of
WIDTH columns. encode_png() writes it, decode_png() reads any non-interlaced 8-bit grey, RGB or RGBA PNG: it checks the
signature and each chunk's CRC, inflates the data and undoes the five row filters in numpy: whole runs of rows at a time
for those that look left or up only, and a diagonal of the image at a time where rows look at both. cosine_hash() averages the
image to a square grid, takes its two-dimensional cosine transform and keeps the signs of the low frequencies against
their median.

Null and empty texts are one row of 576 bytes 255. Equal texts have equal results; long texts need memory in
proportion to their own length. A damaged file raises ValueError. Repeated rows give repeated results, an empty table an
empty one. add_media() carries all columns along, and replaces those that have the names of the new ones; media_digest()
reads the id and text only, whatever other columns are called.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL, WIDTH, PAD = 576, 576, 255
LEVEL = 1
GRID, LOW = 32, 8
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 6: 4}


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode_png(pixels: np.ndarray) -> bytes:
    """A grey image (height x width, uint8) as PNG. Rows use filter 2 (difference to the row above), the first filter 0."""
    height, width = pixels.shape
    rows = np.empty((height, width + 1), np.uint8)
    rows[:, 0] = 2
    rows[0, 0] = 0
    rows[0, 1:] = pixels[0]
    np.subtract(pixels[1:], pixels[:-1], out=rows[1:, 1:])
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.data, LEVEL)) + _chunk(b"IEND", b"")


def _chunks(blob: bytes) -> Iterator[tuple[bytes, bytes]]:
    if blob[:8] != _SIGNATURE:
        raise ValueError("not a PNG file")
    at = 8
    while at + 12 <= len(blob):
        (n,) = struct.unpack_from(">I", blob, at)
        kind, data = blob[at + 4 : at + 8], blob[at + 8 : at + 8 + n]
        if len(data) < n or blob[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(data, zlib.crc32(kind))):
            raise ValueError(f"damaged chunk {kind!r}")
        yield kind, data
        at += 12 + n
        if kind == b"IEND":
            return
    raise ValueError("no IEND chunk")


def _unfilter(kinds: np.ndarray, raw: np.ndarray, step: int) -> np.ndarray:
    """Undoes the row filters. raw: height x bytes per row; step: bytes per pixel."""
    if len(kinds) and kinds.max() > 4:
        raise ValueError(f"unknown filter {kinds.max()}")
    if (kinds > 2).any():
        return _by_diagonals(kinds, raw, step)
    out = np.empty_like(raw)
    height, width = raw.shape
    above = np.zeros(width, np.uint8)
    i = 0
    while i < height:
        kind, j = int(kinds[i]), i + 1
        while j < height and kinds[j] == kind:
            j += 1
        if kind == 0:
            out[i:j] = raw[i:j]
        elif kind == 1:
            out[i:j] = np.cumsum(raw[i:j].reshape(j - i, -1, step), axis=1, dtype=np.uint8).reshape(j - i, width)
        else:
            first = raw[i:j].copy()
            first[0] += above
            out[i:j] = np.cumsum(first, axis=0, dtype=np.uint8)
        above = out[j - 1]
        i = j
    return out


def _by_diagonals(kinds: np.ndarray, raw: np.ndarray, step: int) -> np.ndarray:
    """Filters 3 and 4 need the pixels left, above and between: all pixels of a diagonal can be had at once."""
    height, width = raw.shape
    columns = width // step
    pixels = raw.reshape(height, columns, step).astype(np.int64)
    out = np.zeros((height + 1, columns + 1, step), np.int64)  # with a row above and a column left of the image
    for d in range(height + columns - 1):
        r = np.arange(max(0, d - columns + 1), min(height, d + 1))
        c = d - r
        left, above, corner, kind = out[r + 1, c], out[r, c + 1], out[r, c], kinds[r][:, None]
        near = left + above - corner
        to_left, to_above, to_corner = abs(near - left), abs(near - above), abs(near - corner)
        paeth = np.where((to_left <= to_above) & (to_left <= to_corner), left, np.where(to_above <= to_corner, above, corner))
        guess = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, above, (left + above) // 2, paeth], 0)
        out[r + 1, c + 1] = (pixels[r, c] + guess) & 255
    return out[1:, 1:].reshape(height, width).astype(np.uint8)


def decode_png(blob: bytes) -> np.ndarray:
    """Height x width (x channels, if more than one) of uint8."""
    head, data = None, []
    for kind, body in _chunks(blob):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
    if not head or head[2] != 8 or head[3] not in _CHANNELS or head[6]:
        raise ValueError("not an 8-bit grey, RGB or RGBA image without interlace")
    width, height, step = head[0], head[1], _CHANNELS[head[3]]
    try:
        flat = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    except zlib.error as e:
        raise ValueError(f"damaged data: {e}") from e
    if len(flat) != height * (width * step + 1):
        raise ValueError("wrong amount of data")
    rows = flat.reshape(height, width * step + 1)
    out = _unfilter(rows[:, 0], rows[:, 1:], step)
    return out if step == 1 else out.reshape(height, width, step)


def _cosines(n: int, k: int) -> np.ndarray:
    return np.cos(np.pi * (np.arange(n) + 0.5)[None, :] * np.arange(k)[:, None] / n)


_COSINES = _cosines(GRID, LOW)


def _averaged(pixels: np.ndarray, axis: int) -> np.ndarray:
    """Means of GRID parts along an axis, as even as they can be; a short axis repeats its samples."""
    n = pixels.shape[axis]
    if n < GRID:
        return np.take(pixels, np.arange(GRID) * n // GRID, axis=axis)
    bounds = np.arange(GRID + 1) * n // GRID
    sums = np.add.reduceat(pixels, bounds[:-1], axis=axis, dtype=np.float64)
    sizes = np.diff(bounds)
    return sums / (sizes[:, None] if axis == 0 else sizes)


def cosine_hash(pixels: np.ndarray) -> bytes:
    """LOW * LOW bits: signs of the low frequencies against their median."""
    small = _averaged(_averaged(pixels, 0), 1)
    low = np.round(_COSINES @ small @ _COSINES.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def text_payload(text: str | None) -> tuple[int, bytes]:
    """Length of the UTF-8 bytes, and the padded payload."""
    raw = (text or "").encode()
    return len(raw), raw + bytes([PAD]) * ((max(1, -(-len(raw) // CELL)) * CELL) - len(raw))


def text_image(payload: bytes) -> bytes:
    return encode_png(np.frombuffer(payload, np.uint8).reshape(-1, WIDTH))


def add_media(documents: DataFrame, text_col: str = "text", media_col: str = "media", feature_col: str = "feature") -> DataFrame:
    """The documents with a binary PNG column and a binary column of its cosine hash (read back from the PNG), in the place of
    columns that have these names, if there are any."""
    names = [c for c in documents.columns if c not in (media_col, feature_col)]
    docs = documents.select(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = [text_image(text_payload(t.as_py())[1]) for t in batch.column(text_col)]
            feature = [cosine_hash(decode_png(m)) for m in media]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(media, pa.binary()), pa.array(feature, pa.binary())], [*batch.schema.names, media_col, feature_col])

    schema = docs.limit(0).withColumn(media_col, F.lit(None).cast("binary")).withColumn(feature_col, F.lit(None).cast("binary")).schema
    return docs.mapInArrow(run, schema)


def media_digest(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes each text as an image, reads it back and describes both: lengths, digests, and the cosine hash in hex."""

    def describe(text: str | None) -> tuple:
        n, payload = text_payload(text)
        blob = text_image(payload)
        pixels = decode_png(blob)
        back = pixels.tobytes()
        return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(blob), hashlib.sha256(blob).hexdigest(), cosine_hash(pixels).hex()

    kinds = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*(describe(t.as_py()) for t in batch.column("text")), strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True))], ["doc_id", *kinds])

    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")

import hashlib
import struct
import zlib

import numpy as np
import pytest

from recweld.llm import media as M


def test_digest(spark):
    texts = [None, "", "a", "é" * 400, "x" * 576, "x" * 577, "word " * 40000, "a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'m' as media", "'f' as feature")
    got = {r["doc_id"]: r for r in M.media_digest(df).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        want = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(raw), len(want), zlib.crc32(want[-32:]))
        assert r["payload_sha256"] == hashlib.sha256(want).hexdigest() and len(r["feature"]) == 16
    assert got[2][1:] == got[7][1:]
    full = M.add_media(df).orderBy("doc_id").collect()
    assert [hashlib.sha256(r["media"]).hexdigest() for r in full] == [got[i]["media_sha256"] for i in range(len(texts))]
    assert M.media_digest(df.limit(0)).count() == 0


def plain_filter(pixels, kinds, step):
    """The filters of the PNG specification, byte by byte."""
    h, w = pixels.shape
    p = pixels.astype(int)
    rows = []
    for r in range(h):
        line = [kinds[r]]
        for c in range(w):
            a = p[r, c - step] if c >= step else 0
            b = p[r - 1, c] if r else 0
            d = p[r - 1, c - step] if r and c >= step else 0
            e = a + b - d
            paeth = min(((abs(e - a), 0, a), (abs(e - b), 1, b), (abs(e - d), 2, d)))[2]
            line.append((p[r, c] - (0, a, b, (a + b) // 2, paeth)[kinds[r]]) % 256)
        rows.append(bytes(line))
    return b"".join(rows)


@pytest.mark.parametrize("color,step", [(0, 1), (2, 3), (6, 4)])
def test_reads_all_filters(color, step):
    rng = np.random.default_rng(1)
    pixels = rng.integers(0, 256, (23, 7 * step), np.uint8)
    kinds = rng.integers(0, 5, 23)
    data = zlib.compress(plain_filter(pixels, kinds, step))
    blob = M._SIGNATURE + M._chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 23, 8, color, 0, 0, 0)) + M._chunk(b"IDAT", data[:40]) + M._chunk(b"tEXt", b"x") + M._chunk(b"IDAT", data[40:]) + M._chunk(b"IEND", b"")
    assert (M.decode_png(blob).reshape(23, -1) == pixels).all()
    for bad in (blob[:-5], b"x" + blob[1:], blob[:50] + bytes([blob[50] ^ 1]) + blob[51:]):
        with pytest.raises(ValueError):
            M.decode_png(bad)


def test_hash_is_near_for_near_images():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 256, (64, 64)).astype(np.uint8)
    b = a.copy()
    b[5, 5:9] ^= 3
    bits = lambda x: np.unpackbits(np.frombuffer(M.cosine_hash(x), np.uint8))
    assert (bits(a) != bits(b)).sum() <= 2 < (bits(a) != bits(rng.integers(0, 256, (64, 64)).astype(np.uint8))).sum()


def plain_png(payload):
    """The same image by the PNG specification, byte by byte."""
    rows = [payload[i : i + 576] for i in range(0, len(payload), 576)]
    data = b"".join(bytes([2 if i else 0]) + (bytes((a - b) % 256 for a, b in zip(row, rows[i - 1], strict=True)) if i else row) for i, row in enumerate(rows))
    part = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 576, len(rows), 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(data, 1)) + part(b"IEND", b"")


def plain_hash(payload):
    """Means of a square grid, the cosine transform and the median, in plain loops."""
    from math import cos, pi

    height = len(payload) // 576
    grid = [[0.0] * 32 for _ in range(32)]
    span = lambda n, k: range(k * n // 32, (k + 1) * n // 32) if n >= 32 else [k * n // 32]
    for i in range(32):
        for j in range(32):
            own = [payload[r * 576 + c] for r in span(height, i) for c in span(576, j)]
            grid[i][j] = sum(own) / len(own)
    wave = [[cos(pi * (x + 0.5) * k / 32) for x in range(32)] for k in range(8)]
    rows = [[sum(wave[k][x] * grid[x][j] for x in range(32)) for j in range(32)] for k in range(8)]
    low = [round(sum(rows[k][j] * wave[q][j] for j in range(32)), 6) for k in range(8) for q in range(8)]
    middle = sorted(low[1:])[31]
    return int("".join("1" if v > middle else "0" for v in low), 2).to_bytes(8, "big").hex()


def test_stored_form_and_feature_equal_plain_loops(spark):
    texts = ["", "some words of a text", "x" * 576, "Straße und mehr davon " * 90, "word soup " * 2500]
    got = {r["doc_id"]: r for r in M.media_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        raw = t.encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        blob = plain_png(payload)
        assert (got[i]["media_bytes"], got[i]["media_sha256"]) == (len(blob), hashlib.sha256(blob).hexdigest())
        bits = [int(x, 16) for x in (got[i]["feature"], plain_hash(payload))]
        assert (bits[0] ^ bits[1]).bit_count() <= 1  # a value may lie at the median's rounding


def test_time_on_filters_of_both_neighbours():
    import time

    pixels = np.random.default_rng(3).integers(0, 256, (400, 1200), np.uint8)
    t = time.process_time()
    M._unfilter(np.tile([3, 4], 200), pixels, 3)
    assert time.process_time() - t < 3

"""Byte-level numpy kernels shared by the text operators.

Texts come as Arrow string arrays. Words are found on the UTF-8 bytes: all delimiter sets used here are ASCII, so a
multi-byte character is never cut. Work is done on slices of whole texts of a few MB, which bounds memory by the slice
or by the longest text. Null texts count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20
#: Words are hashed in blocks of about so many bytes, which stay in the cache.
HASH_BYTES = 1 << 18
_U = np.uint64
_MASK = (1 << 64) - 1


def delimiter_table(*ranges: tuple[int, int]) -> np.ndarray:
    """Boolean table over the 256 byte values, true inside the inclusive ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Words of the form [^\x20\x09-\x0D]+.
SPACES = delimiter_table((0x20, 0x20), (0x09, 0x0D))
#: Words of the form [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
NON_ALNUM = delimiter_table((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


def _splitmix(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_LOWER = np.arange(256)
_LOWER[65:91] += 32
EXACT = np.array([_splitmix(1000 + b) for b in range(256)], _U)
_BYTE_CODE = EXACT[_LOWER]
_BASE = _splitmix(7) | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_GRAM = np.array([_splitmix(2000 + i) | 1 for i in range(64)], _U)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = HASH_BYTES
    while size < n:
        size *= 2
    if size not in _powers:
        tables = []
        for base in (_BASE, _BASE_INVERSE):
            steps = np.full(size, base, _U)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        _powers[size] = tuple(tables)
    return _powers[size]


def utf8_buffer(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n + 1 offsets into them; null texts are empty."""
    if array.null_count:
        array = array.fill_null("")
    kind = np.int64 if pa.types.is_large_string(array.type) else np.int32
    _, offsets, data = array.buffers()
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, kind, len(array) + 1, array.offset * kind().itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def give_back() -> None:
    """Returns freed memory to the system: idle workers would else keep the most that any task has needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(array: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of whole texts of about ``most`` bytes; one longer text is its own run."""
    data, offs = utf8_buffer(array)
    n, i = len(offs) - 1, 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + most, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j
    give_back()


def words(data: np.ndarray, offs: np.ndarray, delimiters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each text (and the end) the index of its first word."""
    inside = ~delimiters[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offs[(offs > 0) & (offs < len(data))]
    before[edges] = False
    after[edges - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray = _BYTE_CODE) -> np.ndarray:
    """64-bit hashes of words. By default equal for words that differ in the case of A-Z only; with EXACT for equal bytes."""
    out = np.empty(len(starts), _U)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + HASH_BYTES, side="right")))
        low, high = int(starts[i]), int(ends[j - 1])
        power, inverse = _power_tables(high - low)
        sums = np.zeros(high - low + 1, _U)
        np.cumsum(codes[data[low:high]] * power[: high - low], out=sums[1:])
        a, b = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mix((sums[b] - sums[a]) * inverse[a])
        i = j
    return out


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n items; those that cross texts are the caller's to leave out."""
    if len(hashes) < n:
        return np.zeros(0, _U)
    total = hashes[: len(hashes) - n + 1] * _GRAM[0]
    for i in range(1, n):
        total += hashes[i : len(hashes) - n + 1 + i] * _GRAM[i]
    return mix(total + _U(_splitmix(3000 + int(n))))


def grams_at(hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """As grams(), for the runs that start at the given places only."""
    total = hashes[at] * _GRAM[0]
    for i in range(1, n):
        total += hashes[at + i] * _GRAM[i]
    return mix(total + _U(_splitmix(3000 + int(n))))


def text_of(first: np.ndarray) -> np.ndarray:
    """The index of the text of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def whole(first: np.ndarray, n: int) -> np.ndarray:
    """True where a run of n words lies in one text; as long as grams()."""
    total = int(first[-1])
    left = np.repeat(first[1:], np.diff(first)) - np.arange(total)
    return left[: max(0, total - n + 1)] >= n

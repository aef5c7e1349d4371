"""String similarities by their public definitions: longest common subsequence ratios and Jaro-Winkler.

Scores are floats of 0 to 100 (ratios) or 0 to 1. similarity_columns() evaluates any set of them in one Arrow pass over pairs
of columns; equal pairs of a batch are worked out once. All pairs of a batch advance together: a text of up to 64 characters
is a 64-bit word per pair, with one mask per character (Hyyro 2004), so a step of the comparison is a few numpy operations on
the whole batch. Where both texts are longer, Python's long integers stand for the words, one pair at a time.

Common prefixes and suffixes, and cosines of character grams, are native expressions or numpy over the batch as well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_U = np.uint64
_WORD, _CHUNK = 64, 4096
#: Different characters of a chunk up to which there is a table of masks for each pair.
_ALPHABET = 512
Texts = list[str]


def _codes(texts: Texts) -> tuple[np.ndarray, np.ndarray, int]:
    """Texts as rows of small character codes, filled with the first unused code; their lengths; and that code."""
    sizes = np.array([len(t) for t in texts])
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    alphabet, own = np.unique(points, return_inverse=True)
    out = np.full((len(texts), max(1, int(sizes.max(initial=0)))), len(alphabet), np.int64)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = own
    return out, sizes, len(alphabet)


def _masks(codes: np.ndarray, sizes: np.ndarray, alphabet: int) -> np.ndarray:
    """For each text and character, the bits of its places; for the fill code, none. One flat table, a text after the other."""
    width = alphabet + 1
    table = np.zeros(len(codes) * width, _U)
    for i in range(int(sizes.max(initial=0))):
        rows = np.flatnonzero(sizes > i)
        table[rows * width + codes[rows, i]] |= _U(1) << _U(i)
    return table


def _full(sizes: np.ndarray) -> np.ndarray:
    """As many low bits as each text has characters (64 at most)."""
    return np.where(sizes >= _WORD, _U(2**64 - 1), (_U(1) << np.minimum(sizes, _WORD - 1).astype(_U)) - _U(1))


def _common_long(a: str, b: str) -> int:
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _common_chunk(short: Texts, long: Texts) -> np.ndarray:
    codes, sizes, alphabet = _codes(short + long)
    n = len(short)
    if alphabet > _ALPHABET:
        return np.array([_common_long(x, y) for x, y in zip(short, long, strict=True)])
    table, base = _masks(codes[:n], sizes[:n], alphabet), np.arange(n) * (alphabet + 1)
    other = codes[n:]
    row = _full(sizes[:n])
    for k in range(int(sizes[n:].max(initial=0))):
        hit = row & table[base + other[:, k]]
        row = row + hit | row - hit
    return sizes[:n] - np.bitwise_count(row & _full(sizes[:n])).astype(np.int64)


def common(a: Texts, b: Texts) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs."""
    out = np.zeros(len(a), np.int64)
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b, strict=True)]
    todo = []
    for i, (x, y) in enumerate(pairs):
        if x == y:
            out[i] = len(x)
        elif len(x) > _WORD:
            out[i] = _common_long(x, y)
        elif x:
            todo.append(i)
    todo.sort(key=lambda i: len(pairs[i][1]))
    for k in range(0, len(todo), _CHUNK):
        own = todo[k : k + _CHUNK]
        out[own] = _common_chunk([pairs[i][0] for i in own], [pairs[i][1] for i in own])
    return out


def _lengths(texts: Texts) -> np.ndarray:
    return np.array([len(t) for t in texts], np.int64)


def _share(shared: np.ndarray, total: np.ndarray) -> np.ndarray:
    """200 * shared / total, and 100 where both texts are empty."""
    return np.where(total > 0, 200.0 * shared / np.maximum(total, 1), 100.0)


def ratios(a: Texts, b: Texts) -> np.ndarray:
    return _share(common(a, b), _lengths(a) + _lengths(b))


def token_sort_ratios(a: Texts, b: Texts) -> np.ndarray:
    own = {t: " ".join(sorted(t.split())) for t in {*a, *b}}
    return ratios([own[t] for t in a], [own[t] for t in b])


def token_set_ratios(a: Texts, b: Texts) -> np.ndarray:
    """The best ratio of the shared words, and of these with what each side has besides; 0 if a side has no words.

    The shared words begin both wholes, so they count in full: only the words that one side has are compared.
    """
    words = {t: frozenset(t.split()) for t in {*a, *b}}
    n = len(a)
    shared, left, right = np.zeros(n, np.int64), [""] * n, [""] * n
    empty = np.zeros(n, bool)
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        x, y = words[x], words[y]
        both = x & y
        empty[i] = not x or not y
        shared[i] = sum(map(len, both)) + max(0, len(both) - 1)
        left[i], right[i] = " ".join(sorted(x - both)), " ".join(sorted(y - both))
    la, lb = _lengths(left), _lengths(right)
    some = shared > 0
    gap = lambda k: (some & (k > 0)).astype(np.int64)  # a space between the shared words and others
    wa, wb = shared + gap(la) + la, shared + gap(lb) + lb
    out = _share(shared + gap(np.minimum(la, lb)) + common(left, right), wa + wb)
    for whole in (wa, wb):
        out = np.where(some, np.maximum(out, _share(shared, shared + whole)), out)
    out[some & ((la == 0) | (lb == 0))] = 100.0
    out[empty] = 0.0
    return out


def _windows_chunk(short: Texts, long: Texts) -> np.ndarray:
    """The best ratio of each short text (of 64 characters at most) with any window of the long one, of as many characters or
    cut off at either end. All windows of all pairs advance together."""
    codes, sizes, alphabet = _codes(short + long)
    n = len(short)
    if alphabet > _ALPHABET:
        return np.array([max(float(ratios([x] * 1, [y[max(0, i) : i + len(x)]])[0]) for i in range(1 - len(x), len(y))) for x, y in zip(short, long, strict=True)])
    table, ns, ms = _masks(codes[:n], sizes[:n], alphabet), sizes[:n], sizes[n:]
    # each long text with as many fill codes on both sides as a window may stand out
    padded = ms + 2 * (ns - 1)
    begin = np.concatenate([[0], np.cumsum(padded)])
    flat = np.repeat(np.arange(n) * (alphabet + 1) + alphabet, padded)
    inside = np.arange(codes.shape[1])[None, :] < ms[:, None]
    at = (begin[:-1] + ns - 1)[:, None] + np.arange(codes.shape[1])[None, :]
    flat[at[inside]] = (np.arange(n)[:, None] * (alphabet + 1) + codes[n:])[inside]
    masks = table[flat]
    count = ns + ms - 1
    pair = np.repeat(np.arange(n), count)
    first = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)
    head, size = begin[:-1][pair] + first, ns[pair]
    order = np.argsort(-size, kind="stable")
    head, size, pair, first = head[order], size[order], pair[order], first[order]
    rows = _full(size)
    for k in range(int(ns.max(initial=0))):
        live = int(np.searchsorted(-size, -k))  # windows of more than k characters
        own = rows[:live]
        hit = own & masks[head[:live] + k]
        rows[:live] = own + hit | own - hit
    shared = size - np.bitwise_count(rows & _full(size)).astype(np.int64)
    start = first - (size - 1)
    width = np.minimum(start + size, ms[pair]) - np.maximum(start, 0)
    out = np.zeros(n)
    np.maximum.at(out, pair, _share(shared, size + width))
    return out


def partial_ratios(a: Texts, b: Texts) -> np.ndarray:
    """The best ratio of the shorter text with a window of the longer one; of equally long ones, either way round."""
    out = np.zeros(len(a))
    todo: list[tuple[int, str, str]] = []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if x in y and (x or not y) or y in x and y:
            out[i] = 100.0
        elif x and y:
            if len(x) <= len(y):
                todo.append((i, x, y))
            if len(y) <= len(x):
                todo.append((i, y, x))
    for i, x, y in todo:
        if len(x) > _WORD:
            out[i] = max(out[i], *(200.0 * _common_long(x, w) / (len(x) + len(w)) for k in range(1 - len(x), len(y)) for w in [y[max(0, k) : k + len(x)]]))
    todo = sorted((x for x in todo if len(x[1]) <= _WORD), key=lambda x: len(x[2]))
    for k in range(0, len(todo), _CHUNK // 4):
        own = todo[k : k + _CHUNK // 4]
        np.maximum.at(out, [x[0] for x in own], _windows_chunk([x[1] for x in own], [x[2] for x in own]))
    return out


def _jaro_winkler_long(a: str, b: str) -> float:
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, first = set(), []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j not in taken and b[j] == c), None)
        if j is not None:
            taken.add(j)
            first.append(c)
    if not first:
        return 0.0
    second = [b[j] for j in sorted(taken)]
    m, moved = len(first), sum(x != y for x, y in zip(first, second, strict=True)) // 2
    score = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    same = next((k for k in range(4) if a[k : k + 1] != b[k : k + 1] or not a[k : k + 1]), 4)
    return score + 0.1 * same * (1 - score) if score > 0.7 else score


def _lowest(bits: np.ndarray) -> np.ndarray:
    return bits & (~bits + _U(1))


def _place(bit: np.ndarray) -> np.ndarray:
    """The place of a single bit."""
    return np.bitwise_count(bit - _U(1)).astype(np.int64)


def _jaro_winkler_chunk(a: Texts, b: Texts) -> np.ndarray:
    codes, sizes, alphabet = _codes(a + b)
    n = len(a)
    if alphabet > _ALPHABET:
        return np.array([_jaro_winkler_long(x, y) for x, y in zip(a, b, strict=True)])
    ca, cb, la, lb = codes[:n], codes[n:], sizes[:n], sizes[n:]
    table, base = _masks(cb, lb, alphabet), np.arange(n) * (alphabet + 1)
    reach = np.maximum(0, np.maximum(la, lb) // 2 - 1)
    in_a, in_b = np.zeros(n, _U), np.zeros(n, _U)
    for i in range(int(la.max(initial=0))):
        near = _full(np.minimum(lb, i + reach + 1)) & ~_full(np.minimum(np.maximum(0, i - reach), _WORD))
        found = _lowest(table[base + ca[:, i]] & ~in_b & near)
        in_b |= found
        in_a |= np.where(found > 0, _U(1) << _U(i), _U(0))
    m = np.bitwise_count(in_a).astype(np.int64)
    moved, x, y, rows = np.zeros(n, np.int64), in_a.copy(), in_b.copy(), np.arange(n)
    for _ in range(int(m.max(initial=0))):
        p, q = _lowest(x), _lowest(y)
        live = p > 0
        moved += live & (ca[rows, np.where(live, _place(p), 0)] != cb[rows, np.where(live, _place(q), 0)])
        x, y = x ^ p, y ^ q
    k = np.maximum(m, 1)
    score = np.where(m > 0, (m / np.maximum(la, 1) + m / np.maximum(lb, 1) + (m - moved // 2) / k) / 3, 0.0)
    width = min(4, ca.shape[1])
    equal = (ca[:, :width] == cb[:, :width]) & (np.arange(width)[None, :] < np.minimum(la, lb)[:, None])
    same = np.cumprod(equal, axis=1).sum(axis=1)
    return np.where(score > 0.7, score + 0.1 * same * (1 - score), score)


def jaro_winklers(a: Texts, b: Texts) -> np.ndarray:
    """0 if either is empty."""
    out = np.zeros(len(a))
    todo = []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if max(len(x), len(y)) > _WORD:
            out[i] = _jaro_winkler_long(x, y) if x and y else 0.0
        elif x and y:
            todo.append(i)
    todo.sort(key=lambda i: len(a[i]))
    for k in range(0, len(todo), _CHUNK):
        own = todo[k : k + _CHUNK]
        out[own] = _jaro_winkler_chunk([a[i] for i in own], [b[i] for i in own])
    return out


MEASURES: dict[str, Callable[[Texts, Texts], np.ndarray]] = {"ratio": ratios, "token_sort_ratio": token_sort_ratios, "token_set_ratio": token_set_ratios, "partial_ratio": partial_ratios, "jaro_winkler": jaro_winklers}


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix, natively: the longest head of a that b begins with."""
    return F.length(F.regexp_extract(F.concat(a, F.lit("\0"), b), "(?s)^([^\0]*)[^\0]*\0\\1", 1))


def prefix_similarity(a: str, b: str) -> Column:
    """The common prefix's share of the longer text; 1 for two empty ones."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, common_prefix(F.col(a), F.col(b)) / longest).otherwise(F.lit(1.0))


def suffix_similarity(a: str, b: str) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, common_prefix(F.reverse(a), F.reverse(b)) / longest).otherwise(F.lit(1.0))


# --- grams of three characters ------------------------------------------------------------------------------------------

_SYMBOLS = " abcdefghijklmnopqrstuvwxyz0123456789"
#: All grams of normalised texts (lower-case ASCII words): a table of their weights has a fixed size.
GRAMS = len(_SYMBOLS) ** 3
_CODE = np.zeros(256, np.int64)
_CODE[[ord(c) for c in _SYMBOLS]] = np.arange(len(_SYMBOLS))


def gram_code(gram: str) -> int:
    return int(np.dot(_CODE[np.frombuffer(gram.encode("latin-1", "replace"), np.uint8)], [len(_SYMBOLS) ** 2, len(_SYMBOLS), 1]))


def gram_weights(texts: Texts, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text, its grams (text number * GRAMS + code, ascending) and their weights (1 + ln tf) * idf, of length one."""
    data = np.frombuffer((" " + "  ".join(texts) + " ").encode("latin-1", "replace"), np.uint8) if texts else np.zeros(0, np.uint8)
    code = _CODE[data]
    owner = np.repeat(np.arange(len(texts)), _lengths(texts) + 2)
    if len(code) < 3:
        return np.zeros(0, np.int64), np.zeros(0)
    inside = (owner[2:] == owner[:-2]) & (code[1:-1] != 0)
    keys = (owner[2:] * GRAMS + (code[:-2] * len(_SYMBOLS) + code[1:-1]) * len(_SYMBOLS) + code[2:])[inside]
    keys, tf = np.unique(keys, return_counts=True)
    w = (1 + np.log(tf)) * idf[keys % GRAMS]
    length = np.sqrt(np.bincount(keys // GRAMS, weights=w * w, minlength=len(texts)))
    return keys, w / length[keys // GRAMS]


def gram_cosines(a: Texts, b: Texts, idf: np.ndarray) -> np.ndarray:
    number = {t: i for i, t in enumerate(dict.fromkeys([*a, *b]))}
    keys, w = gram_weights(list(number), idf)
    bounds = np.searchsorted(keys, np.arange(len(number) + 1) * GRAMS)
    x, y = np.array([number[t] for t in a], np.int64), np.array([number[t] for t in b], np.int64)
    sizes = bounds[x + 1] - bounds[x]
    pair = np.repeat(np.arange(len(x)), sizes)
    at = np.arange(len(pair)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + bounds[x][pair]
    wanted = keys[at] % GRAMS + y[pair] * GRAMS
    place = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    dot = np.where(keys[place] == wanted, w[at] * w[place], 0.0) if len(keys) else np.zeros(0)
    return np.bincount(pair, weights=dot, minlength=len(x))


def similarity_columns(wanted: dict[str, tuple[str, str, str]], grams: dict[str, tuple[str, str, Broadcast]] | None = None) -> Column:
    """A struct column of similarities, null if either side is. wanted: field -> (measure, left column, right column).
    grams: field -> (left column, right column, weights of all grams), for cosines of normalised texts."""
    grams = grams or {}
    sides = [x[1:] for x in wanted.values()] + [x[:2] for x in grams.values()]
    columns = list(dict.fromkeys(c for pair in sides for c in pair))
    measures = [(lambda a, b, f=MEASURES[m]: f(a, b)) for m, _, _ in wanted.values()] + [(lambda a, b, t=t: gram_cosines(a, b, t.value)) for _, _, t in grams.values()]
    plan = [(name, measure, columns.index(a), columns.index(b)) for name, measure, (a, b) in zip([*wanted, *grams], measures, sides, strict=True)]

    @F.pandas_udf(T.StructType([T.StructField(name, T.DoubleType()) for name, *_ in plan]))
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for struct in batches:
            texts = [struct.iloc[:, i].tolist() for i in range(struct.shape[1])]
            known: dict[tuple[int, int], tuple[list, np.ndarray]] = {}
            out = {}
            for name, measure, i, j in plan:
                if (i, j) not in known:
                    number: dict = {}
                    at = np.array([number.setdefault(p, len(number)) if p[0] is not None and p[1] is not None else -1 for p in zip(texts[i], texts[j], strict=True)], np.int64)
                    known[i, j] = list(number), at
                pairs, at = known[i, j]
                values = measure([p[0] for p in pairs], [p[1] for p in pairs])
                out[name] = np.where(at < 0, np.nan, np.append(values, np.nan)[at])
            yield pd.DataFrame(out)

    own = compare(F.struct(*[F.col(c).cast("string") for c in columns]))
    return F.struct(*[F.when(~F.isnan(own[name]), own[name]).alias(name) for name, *_ in plan])

"""Language-model scores from quantised n-gram counts in a log-frequency Bloom filter.

Counting: each slice of texts is cut into words and one end token per text; distinct tokens and pairs of a slice are
counted and sent, packed, to the bucket of their 64-bit hash. A bucket adds them up: exact counts of its tokens, and a
filter of its pairs. A pair seen c times has level 1 + floor(log2 c) and is put into the filter once for each level up to
its own, so probing level after level until one is missing gives the level (never too low; too high with the filter's
small error rate). A level stands for the smallest count it holds; no estimate exceeds the exact count of either token.

Scoring: p(w | h) = (c(h, w) + KAPPA * p(w)) / (c(h) + KAPPA), with p(w) = (c(w) + 1) / (N + V + 1) and the end token as
the context of a first word.

Probing: by default each slice's distinct keys go to the buckets of their hashes once, held-out texts' with count 0; a
bucket counts, builds its filter, probes it for all keys it was sent and returns counts and levels to the slices (see
_by_bucket()). With ``broadcast_bytes``, tables within it are broadcast instead; the buckets, filters and scores are the
same. Either way no task holds more than a bucket with the keys it was sent, or a slice with its own; the number of
buckets follows the size of the texts, and no single key can fill one, as slices are counted before they are sent. A slice
sends a message to a bucket only if it has a key there: there are never more messages than distinct keys of slices.

Null and empty texts are one end token. Repeated rows count, and are scored, repeatedly. Without training texts, N and V
are 0. An empty table gives an empty result. Only the id and text and what ``train`` and ``extra`` name are read, whatever
other columns are called.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import stored

KAPPA = 2.0
#: Text per bucket; a bucket holds the distinct pairs of about so many bytes of text.
BUCKET_BYTES = 8 << 20
BITS, PROBES = 12, 4
_SLICE = 6 << 20
_SLICE_COL, _TRAIN = "_slice", "_train"
_END = np.uint64(0x5DEECE66D1234567)
_U = np.uint64


def _tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts with an end token after each, and where each text's begin (n + 1)."""
    starts, ends, first = K.words(data, offs, K.SPACES)
    n = len(first) - 1
    out = np.empty(len(starts) + n, _U)
    last = np.zeros(len(out), bool)
    last[first[1:] + np.arange(n)] = True
    out[last] = _END
    out[~last] = K.word_hashes(data, starts, ends)
    return out, first + np.arange(n + 1)


def _pairs(tokens: np.ndarray) -> np.ndarray:
    """The hash of each token with the one before it; before a text's first is the end token of another."""
    return K.grams(np.concatenate([[_END], tokens]), 2)


def _bucket_bounds(n: int) -> np.ndarray:
    return np.array([((i << 64) // n) for i in range(1, n)], _U)


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(counts)).astype(np.int64) + 1


def _masks(h: np.ndarray) -> np.ndarray:
    out = np.zeros(len(h), _U)
    for i in range(PROBES):
        out |= _U(1) << ((h >> _U(6 * i)) & _U(63))
    return out


def _level_hash(keys: np.ndarray, level: int) -> np.ndarray:
    return K.mix(keys + _U(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


def _place(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return (((h >> _U(32)) * sizes) >> _U(32)).astype(np.int64)


def build_filter(keys: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """A Bloom filter of 64-bit words: PROBES bits in one word for each key and level."""
    total = int(levels.sum())
    words = np.zeros(max(1, -(-total * BITS // 64)), _U)
    size = _U(len(words))
    for level in range(1, int(levels.max(initial=0)) + 1):
        h = _level_hash(keys[levels >= level], level)
        np.bitwise_or.at(words, _place(h, size), _masks(h))
    return words


class Tables:
    """What is broadcast: sorted token hashes with counts, and the buckets' filters one after the other."""

    def __init__(self, rows: Iterable, sizes: list):
        """rows: the buckets; sizes: of each in order, (bucket, tokens, filter words), so that each row is copied once."""
        sizes = sorted(sizes)
        self.buckets = np.array([x[0] for x in sizes], np.int64)
        self.sizes = np.array([x[2] for x in sizes], _U)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        begins = np.concatenate([[0], np.cumsum([x[1] for x in sizes])]).astype(np.int64)
        self.distinct, self.n_buckets = int(begins[-1]), 1
        self.words, self.counts = np.empty(self.distinct, _U), np.empty(self.distinct, np.int64)
        self.filter = np.empty(self.starts[-1], _U)
        for r in rows:
            i = int(np.searchsorted(self.buckets, r["bucket"]))
            self.words[begins[i] : begins[i + 1]] = np.frombuffer(r["words"], _U)
            self.counts[begins[i] : begins[i + 1]] = np.frombuffer(r["counts"], np.int64)
            self.filter[self.starts[i] : self.starts[i + 1]] = np.frombuffer(r["filter"], _U)
            self.n_buckets = r["n_buckets"]
        self.total = int(self.counts.sum())
        if self.counts.max(initial=0) < 1 << 32:
            self.counts = self.counts.astype(np.uint32)

    def count(self, keys: np.ndarray) -> np.ndarray:
        if not self.distinct:
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.words, keys), self.distinct - 1)
        return np.where(self.words[at] == keys, self.counts[at], 0).astype(np.int64)

    def level(self, keys: np.ndarray) -> np.ndarray:
        """Repeated membership probes: the last level of each key that is in the filter."""
        out = np.zeros(len(keys), np.int64)
        if not len(self.buckets):
            return out
        bucket = np.searchsorted(_bucket_bounds(self.n_buckets), keys, side="right")
        row = np.minimum(np.searchsorted(self.buckets, bucket), len(self.buckets) - 1)
        left = np.flatnonzero(self.buckets[row] == bucket)
        level = 1
        while len(left):
            h, own = _level_hash(keys[left], level), row[left]
            mask = _masks(h)
            inside = (self.filter[self.starts[own] + _place(h, self.sizes[own])] & mask) == mask
            left = left[inside]
            out[left] = level
            level += 1
        return out


def _add_up(keys: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    k = np.frombuffer(b"".join(keys), _U)
    if not len(k):
        return k, np.zeros(0, np.int64)
    c = np.frombuffer(b"".join(counts), np.uint32)
    order = np.argsort(k)
    k = k[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[first], np.add.reduceat(c[order].astype(np.int64), first)


def _counted(texts: DataFrame, n_buckets: int) -> DataFrame:
    """Packed partial counts: (bucket, words, counts, pairs, pair_counts), a few rows per slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = _bucket_bounds(n_buckets)
        for batch in batches:
            for _, _, data, offs in K.slices(batch.column(0), _SLICE):
                tokens, _ = _tokens(data, offs)
                own = [np.unique(keys, return_counts=True) for keys in (tokens, _pairs(tokens))]
                buckets = [np.searchsorted(bounds, keys, side="right") for keys, _ in own]
                asked, columns = np.unique(np.concatenate(buckets)), []
                for (keys, counts), bucket in zip(own, buckets, strict=True):
                    ends = list(zip(np.searchsorted(bucket, asked), np.searchsorted(bucket, asked, side="right"), strict=True))
                    columns += [pa.array([values[a:b].tobytes() for a, b in ends], pa.binary()) for values in (keys, counts.astype(np.uint32))]
                yield pa.RecordBatch.from_arrays([pa.array(asked, pa.int64()), *columns], ["bucket", "words", "counts", "pairs", "pair_counts"])

    return texts.mapInArrow(run, "bucket long, words binary, counts binary, pairs binary, pair_counts binary")


def _reduced(counted: DataFrame, n_buckets: int) -> DataFrame:
    def run(group: pa.Table) -> pa.Table:
        words, counts = _add_up(group["words"].to_pylist(), group["counts"].to_pylist())
        pairs, pair_counts = _add_up(group["pairs"].to_pylist(), group["pair_counts"].to_pylist())
        made = build_filter(pairs, levels_of(pair_counts)) if len(pairs) else np.zeros(0, _U)
        return pa.table({"bucket": group["bucket"][:1], "n_buckets": pa.array([n_buckets], pa.int64()), "words": pa.array([words.tobytes()], pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary()), "filter": pa.array([made.tobytes()], pa.binary())})

    return counted.groupBy("bucket").applyInArrow(run, "bucket long, n_buckets long, words binary, counts binary, filter binary")


def _log_scores(c: np.ndarray, context: np.ndarray, pair: np.ndarray, total: int, distinct: int) -> tuple[np.ndarray, np.ndarray]:
    """log10 of the base and of the smoothed probability of each token."""
    base = (c + 1) / (total + distinct + 1)
    pair = np.minimum(pair, np.minimum(c, context))
    return np.log10(base), np.log10((pair + KAPPA * base) / (context + KAPPA))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first[:-1]) if len(first) > 1 else np.zeros(0, values.dtype)


_OUT = "n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(part: pa.RecordBatch, names: list[str], first: np.ndarray, c, context, pair, total: int, distinct: int) -> pa.RecordBatch:
    base, smooth = _log_scores(c, context, pair, total, distinct)
    n = len(first) - 1
    columns = [pa.array(np.diff(first), pa.int64()), pa.array(_sums((c > 0).astype(np.int64), first), pa.int64()), pa.array(np.full(n, total), pa.int64()), pa.array(_sums(base, first)), pa.array(_sums(smooth, first))]
    return pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(x)) for x in names), *columns], [*names, "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def score(documents: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None, broadcast_bytes: int = 0, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per document row: its id, extra columns, n_tokens, n_known, train_tokens, base_score, score.

    train: which rows to learn from. All rows are scored. broadcast_bytes: tables up to this size are broadcast instead of
    probed bucket by bucket, with the same scores; by default none is, so that every size runs the same way.
    """
    spark = documents.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    marked = documents.select(F.col(id_col).alias("doc_id"), *(x.alias(k) for k, x in (extra or {}).items()), text, F.coalesce(train, F.lit(False)).alias(_TRAIN))
    docs = marked.drop(_TRAIN)
    texts = documents.where(train).select(text)
    size = docs.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    n_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / bucket_bytes))
    if not broadcast_bytes:
        return _by_bucket(marked, n_buckets)
    tables = stored(_reduced(_counted(texts, n_buckets), n_buckets), "ngrams")
    held = tables.agg(F.sum(F.length("words") + F.length("counts") + F.length("filter"))).first()[0] or 0
    if held > broadcast_bytes:
        return _by_bucket(marked, n_buckets)
    sizes = [(r["bucket"], r["n"] // 8, r["f"] // 8) for r in tables.select("bucket", F.length("words").alias("n"), F.length("filter").alias("f")).collect()]
    shared = spark.sparkContext.broadcast(Tables(tables.toLocalIterator(), sizes))
    names = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for batch in batches:
            for i, j, data, offs in K.slices(batch.column(batch.schema.get_field_index("text"))):
                tokens, first = _tokens(data, offs)
                unique, inverse = np.unique(tokens, return_inverse=True)
                c = t.count(unique)[inverse]
                context = np.concatenate([t.count(np.array([_END], _U)), c[:-1]])
                seen = np.flatnonzero((c > 0) & (context > 0))
                level = np.zeros(len(c), np.int64)
                level[seen] = t.level(_pairs(tokens)[seen])
                yield _scored(batch.slice(i, j - i), names, first, c, context, np.where(level, 1 << np.maximum(level - 1, 0), 0), t.total, t.distinct)

    return docs.mapInArrow(run, f"{_kinds(docs)}, {_OUT}")


def _kinds(docs: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")


def _planes(values: np.ndarray) -> bytes:
    """64-bit values byte by byte, the highest first: what is equal in sorted keys and small numbers packs well."""
    return values.astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(">u8").ravel().astype(_U)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts the keys, where each distinct one begins in it, and the number of each key's distinct one."""
    order = np.argsort(keys)
    ordered = keys[order]
    begins = np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(keys)]
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(begins) - 1
    return order, np.flatnonzero(begins), number


def _added(keys: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys of a bucket, their counts, each sent key's number among them, and where each message begins."""
    parts = [_from_planes(k) for k in keys]
    sent = np.concatenate(parts)
    order, first, number = _runs(sent)
    c = np.frombuffer(b"".join(counts), np.uint32)[order].astype(np.int64)
    counts = np.add.reduceat(c, first) if len(first) else np.zeros(0, np.int64)
    return sent[order[first]], counts, number, np.cumsum([0, *map(len, parts)])


def _by_bucket(docs: DataFrame, n_buckets: int) -> DataFrame:
    """Each slice's distinct keys are sent once, with their counts in training texts (0 in others); each bucket builds its
    filter, probes it for all keys it was sent, and the answers meet their slice's texts.

    One plan: texts are dealt by slice once, and keys by bucket once (the exchanges are used twice).
    """
    names = [c for c in docs.columns if c not in ("text", _TRAIN)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for i, j, _, _ in K.slices(batch.column(batch.schema.get_field_index("text")), _SLICE):
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(j - i, number), pa.int64())], [*part.schema.names, _SLICE_COL])
                number += 1

    def keys_of(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        tokens, first = _tokens(*K.utf8_buffer(pa.concat_arrays(texts.chunks)))
        return tokens, _pairs(tokens), first

    def ask(group: pa.Table) -> pa.Table:
        tokens, pairs, first = keys_of(group["text"])
        learnt = np.repeat(group[_TRAIN].to_numpy().astype(np.int64), np.diff(first))
        bounds = _bucket_bounds(n_buckets)
        found = []
        for keys, seen in ((np.append(tokens, _END), np.append(learnt, 0)), (pairs, learnt)):
            order, begins, _ = _runs(keys)
            counts, keys = np.add.reduceat(seen[order], begins).astype(np.uint32), keys[order[begins]]
            found.append((keys, counts, np.searchsorted(bounds, keys, side="right")))
        asked = np.unique(np.concatenate([x[2] for x in found]))
        columns = []
        for keys, counts, bucket in found:
            ends = list(zip(np.searchsorted(bucket, asked), np.searchsorted(bucket, asked, side="right"), strict=True))
            columns += [pa.array([_planes(keys[a:b]) for a, b in ends], pa.binary()), pa.array([counts[a:b].tobytes() for a, b in ends], pa.binary())]
        number = pa.array(np.full(len(asked), group[_SLICE_COL][0].as_py()), pa.int64())
        return pa.Table.from_arrays([number, pa.array(asked, pa.int64()), *columns], ["slice", "bucket", "words", "counts", "pairs", "pair_counts"])

    def size_of(group: pa.Table) -> pa.Table:
        _, counts, _, _ = _added(group["words"].to_pylist(), group["counts"].to_pylist())
        return pa.table({"total": pa.array([int(counts.sum())], pa.int64()), "distinct": pa.array([int((counts > 0).sum())], pa.int64())})

    def answer(group: pa.Table) -> pa.Table:
        _, counts, number, at = _added(group["words"].to_pylist(), group["counts"].to_pylist())
        found = [_planes(counts[number[a:b]]) for a, b in zip(at[:-1], at[1:], strict=True)]
        pairs, counts, number, at = _added(group["pairs"].to_pylist(), group["pair_counts"].to_pylist())
        seen, bucket = counts > 0, group["bucket"][0].as_py()
        made = build_filter(pairs[seen], levels_of(counts[seen]))
        held = Tables([{"bucket": bucket, "n_buckets": n_buckets, "words": b"", "counts": b"", "filter": made.tobytes()}], [(bucket, 0, len(made))])
        level = held.level(pairs).astype(np.uint8)
        levels = [level[number[a:b]].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        return pa.table({"slice": group["slice"], "bucket": group["bucket"], "found": pa.array(found, pa.binary()), "levels": pa.array(levels, pa.binary())})

    def finish(texts: pa.Table, known: pa.Table) -> pa.Table:
        tokens, pairs, first = keys_of(texts["text"])
        known = known.sort_by("bucket")
        c = np.concatenate([_from_planes(x) for x in known["found"].to_pylist()]).astype(np.int64)
        level = np.frombuffer(b"".join(known["levels"].to_pylist()), np.uint8).astype(np.int64)
        _, _, number = _runs(np.append(tokens, _END))
        c = c[number]
        context = np.concatenate([c[-1:], c[:-2]])
        level = level[_runs(pairs)[2]]
        part = pa.RecordBatch.from_arrays([pa.concat_arrays(texts[x].chunks) for x in names], names)
        total, distinct = known["total"][0].as_py(), known["distinct"][0].as_py()
        return pa.Table.from_batches([_scored(part, names, first, c[:-1], context, np.where(level, 1 << np.maximum(level - 1, 0), 0), total, distinct)])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    rows = docs.mapInArrow(cut, f"{fields}, {_SLICE_COL} long")
    asked = rows.groupBy(_SLICE_COL).applyInArrow(ask, "slice long, bucket long, words binary, counts binary, pairs binary, pair_counts binary")
    totals = asked.groupBy("bucket").applyInArrow(size_of, "total long, distinct long").agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("total", "distinct")))
    answers = asked.groupBy("bucket").applyInArrow(answer, "slice long, bucket long, found binary, levels binary").crossJoin(F.broadcast(totals))
    return rows.groupBy(_SLICE_COL).cogroup(answers.groupBy("slice")).applyInArrow(finish, f"{_kinds(docs.select(names))}, {_OUT}")

"""Benchmark decontamination by winnowing.

Both sides are lower-cased and cut into words. All runs of GRAM words are hashed and the smallest hash of every WINDOW
consecutive runs is kept as a fingerprint, so that two texts that share ``span = GRAM + WINDOW - 1`` words share the
fingerprint of that span. The benchmark's fingerprints are joined with those of the documents; each joint fingerprint is
extended to the whole span, which must be a span of the benchmark word for word (two independent 64-bit hashes agree).
A benchmark item of fewer words than the span is looked up whole.

The benchmark is the query set: it is broadcast in blocks of at most ``block_bytes`` of text. Up to one block, there is no
shuffle; more blocks are run one after the other over the stored documents, and their hits are merged by row. Blocks are cut
from running totals of the items' bytes, so copies of one item do not fill a block; an item longer than a block is one by
itself. Documents are never gathered.

Nulls and empty texts: no words, never hit; a null or empty item has no window. Repeated rows give repeated results. A
null item_id takes part in hits and counts as an item, but is not listed in items_sha256; two items of one id are two. Empty tables give empty or
unhit results. Only the id and text columns are read; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import stored

GRAM, WINDOW = 5, 6
SPAN = GRAM + WINDOW - 1
BLOCK_BYTES = 32 << 20


def _runs_min(values: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every n consecutive values."""
    out, width = values, 1
    while width < n:
        step = min(width, n - width)
        out = np.minimum(out[: len(out) - step], out[step:])
        width += step
    return out


class _Lookup:
    """Sorted keys, each with the items it belongs to."""

    def __init__(self, keys: np.ndarray, items: np.ndarray):
        order = np.lexsort((items, keys))
        keys, items = keys[order], items[order]
        if len(keys):
            once = np.ones(len(keys), bool)
            once[1:] = (keys[1:] != keys[:-1]) | (items[1:] != items[:-1])
            keys, items = keys[once], items[once]
        self.keys, self.first = np.unique(keys, return_index=True)
        self.first = np.append(self.first, len(items))
        self.items = items
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self._low(self.keys)] = True

    @staticmethod
    def _low(keys: np.ndarray) -> np.ndarray:
        return (keys & np.uint64((1 << 20) - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the keys that are in the table, and their places in it."""
        at = np.flatnonzero(self.seen[self._low(keys)])
        if not len(self.keys) or not len(at):
            return at[:0], at[:0]
        place = np.minimum(np.searchsorted(self.keys, keys[at]), len(self.keys) - 1)
        same = self.keys[place] == keys[at]
        return at[same], place[same]

    def items_of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items of each place, with the index of the place they came from."""
        sizes = self.first[places + 1] - self.first[places]
        source = np.repeat(np.arange(len(places)), sizes)
        inner = np.arange(len(source)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.items[self.first[places][source] + inner], source


class Index:
    """What is broadcast of one block of the benchmark: fingerprints, spans, and the short items by their length."""

    def __init__(self, texts: list[str | None]):
        data, offs = K.utf8_buffer(pa.array(texts, pa.string()))
        starts, ends, first = K.words(data, offs, K.NON_ALNUM)
        hashes, item = K.word_hashes(data, starts, ends), K.text_of(first)
        valid = np.flatnonzero(K.whole(first, SPAN))
        self.spans = _Lookup(K.grams(hashes, SPAN)[valid], item[valid])
        prints = _runs_min(K.grams(hashes, GRAM), WINDOW)[valid] if len(valid) else np.zeros(0, np.uint64)
        self.prints = _Lookup(prints, np.zeros(len(prints), np.int64))
        self.short: dict[int, _Lookup] = {}
        counts = np.diff(first)
        for n in range(1, SPAN):
            own = np.flatnonzero(counts == n)
            if len(own):
                self.short[n] = _Lookup(K.grams(hashes, n)[first[own]], own)

    def hits(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word mask of hit words; texts and items of the occurrences, each pair once."""
        delta = np.zeros(len(hashes) + 1, np.int64)
        text = K.text_of(first)
        pairs: list[np.ndarray] = []

        def add(at: np.ndarray, lookup: _Lookup, places: np.ndarray, n: int) -> None:
            np.add.at(delta, at, 1)
            np.add.at(delta, at + n, -1)
            both = np.unique(np.stack([text[at], places]), axis=1)
            items, source = lookup.items_of(both[1])
            pairs.append(np.stack([both[0][source], items]))

        if len(self.prints.keys) and len(hashes) >= SPAN:
            lowest = _runs_min(K.grams(hashes, GRAM), WINDOW)
            fresh = np.ones(len(lowest), bool)
            fresh[1:] = lowest[1:] != lowest[:-1]
            kept = np.flatnonzero(fresh)
            joint, _ = self.prints.find(lowest[kept])
            ends = np.append(kept, len(lowest))
            at = np.concatenate([np.arange(ends[j], ends[j + 1]) for j in joint] or [np.zeros(0, np.int64)])
            at = at[K.whole(first, SPAN)[at]]
            if len(at):
                span = K.grams_at(hashes, at, SPAN)
                found, places = self.spans.find(span)
                if len(found):
                    add(at[found], self.spans, places, SPAN)
        for n, lookup in self.short.items():
            if len(hashes) >= n:
                at, places = lookup.find(K.grams(hashes, n))
                inside = K.whole(first, n)[at]
                if inside.any():
                    add(at[inside], lookup, places[inside], n)
        found = np.unique(np.concatenate(pairs, axis=1), axis=1) if pairs else np.zeros((2, 0), np.int64)
        return np.cumsum(delta[:-1]) > 0, found[0], found[1]


def _digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def _result(ids: list[str | None]) -> tuple[int, str]:
    return len(ids), _digest([x for x in ids if x is not None])


def decontaminate(
    documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row per document row: its id, n_words, n_hit, n_items, items_sha256, contaminated."""
    spark = documents.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).where("text is not null")
    blocks = _item_blocks(items, block_bytes)
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    if len(blocks) == 1:
        return _pass(docs, *_block(spark, blocks[0]), id_type)
    # rows get their numbers once: a task that ran again over other rows would number them otherwise
    docs = stored(docs.withColumn("row", F.monotonically_increasing_id()), "documents")
    parts = None
    for block in blocks:
        part = _partial_pass(docs, *_block(spark, block), id_type)
        parts = part if parts is None else parts.unionAll(part)
    return parts.groupBy("row").applyInArrow(_merge, f"doc_id {id_type}, {_COLUMNS}")


def _item_blocks(items: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The benchmark's items, dealt to blocks of at most block_bytes and one item more: by a hash of their number, so that
    copies are spread evenly, and by the bytes before them where a part holds more than a block."""
    size = F.octet_length("text") + 32
    total = items.agg(F.sum(size)).first()[0] or 0
    if total <= block_bytes:
        return [items]
    parts = math.ceil(total / block_bytes)
    kept = stored(items.withColumns({"bytes": size, "own": F.monotonically_increasing_id()}).withColumn("part", F.pmod(F.xxhash64("own"), F.lit(parts))), "items")
    dealt = stored(kept.withColumn("block", F.expr(f"cast(coalesce(sum(bytes) over (partition by part order by own rows between unbounded preceding and 1 preceding), 0) div {block_bytes} as long)")).drop("own", "bytes"), "blocks")
    keys = dealt.select("part", "block").distinct().orderBy("part", "block").collect()
    return [dealt.where((F.col("part") == r["part"]) & (F.col("block") == r["block"])).select("item", "text") for r in keys]


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without a hit word, all columns as they are. Blocks of the benchmark filter one after the other."""
    items = benchmark.select(F.lit(None).cast("string").alias("item"), F.col(item_text_col).alias("text")).where("text is not null")
    for block in _item_blocks(items, block_bytes):
        _, index = _block(documents.sparkSession, block)

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, j, data, offs in K.slices(batch.column(batch.schema.get_field_index(text_col))):
                    starts, ends, first = K.words(data, offs, K.NON_ALNUM)
                    mask, _, _ = index.value.hits(K.word_hashes(data, starts, ends), first)
                    total = np.concatenate([[0], np.cumsum(mask)])
                    yield batch.slice(i, j - i).filter(pa.array(total[first[1:]] == total[first[:-1]]))

        documents = documents.mapInArrow(run, documents.schema)
    return documents


_COLUMNS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _block(spark, items: DataFrame):
    rows = items.select("item", "text").toPandas()
    ids = rows["item"].where(rows["item"].notna(), None).tolist()
    return spark.sparkContext.broadcast(ids), spark.sparkContext.broadcast(Index(rows["text"].tolist()))


def _scan(batch: pa.RecordBatch, index: Index):
    """For each slice of a batch: first and last row, first words, hit mask, texts and items of the occurrences."""
    for i, j, data, offs in K.slices(batch.column("text")):
        starts, ends, first = K.words(data, offs, K.NON_ALNUM)
        yield i, j, first, *index.hits(K.word_hashes(data, starts, ends), first)


def _pass(docs: DataFrame, ids, index, id_type: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, lookup = ids.value, index.value
        nothing = _digest([])
        for batch in batches:
            n_words, n_hit, n_items, sha = [], [], [], []
            for i, j, first, mask, texts, items in _scan(batch, lookup):
                total = np.concatenate([[0], np.cumsum(mask)])
                bounds = np.searchsorted(texts, np.arange(j - i + 1))
                n_words.append(np.diff(first))
                n_hit.append(total[first[1:]] - total[first[:-1]])
                n_items.append(np.diff(bounds))
                sha += [_result([names[x] for x in items[a:b]])[1] if b > a else nothing for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            if not sha:
                continue
            hit = np.concatenate(n_hit)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(n_words), pa.int64()), pa.array(hit, pa.int64()), pa.array(np.concatenate(n_items), pa.int64()), pa.array(sha, pa.string()), pa.array(hit > 0)], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return docs.mapInArrow(run, f"doc_id {id_type}, {_COLUMNS}")


def _partial_pass(docs: DataFrame, ids, index, id_type: str) -> DataFrame:
    """As _pass, for one of several blocks: rows carry the hit mask (packed bits) and the items themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, lookup = ids.value, index.value
        for batch in batches:
            n_words, bits, found = [], [], []
            for i, j, first, mask, texts, items in _scan(batch, lookup):
                bounds = np.searchsorted(texts, np.arange(j - i + 1))
                n_words += np.diff(first).tolist()
                for k in range(j - i):
                    own = mask[first[k] : first[k + 1]]
                    bits.append(np.packbits(own).tobytes() if own.any() else b"")
                    found.append([names[x] for x in items[bounds[k] : bounds[k + 1]]])
            if n_words:
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(bits, pa.binary()), pa.array(found, pa.list_(pa.string()))], ["row", "doc_id", "n_words", "bits", "items"])

    return docs.mapInArrow(run, f"row long, doc_id {id_type}, n_words long, bits binary, items array<string>")


def _merge(group: pa.Table) -> pa.Table:
    """The blocks' rows of one document row; as many as there are blocks."""
    mask = np.zeros(group["n_words"][0].as_py(), bool)
    names: list[str | None] = []
    for bits, items in zip(group["bits"].to_pylist(), group["items"].to_pylist(), strict=True):
        if bits:
            mask |= np.unpackbits(np.frombuffer(bits, np.uint8), count=len(mask)).astype(bool)
        names += items
    n, sha = _result(names)
    hit = int(mask.sum())
    return pa.table({"doc_id": group["doc_id"][:1], "n_words": pa.array([len(mask)], pa.int64()), "n_hit": pa.array([hit], pa.int64()), "n_items": pa.array([n], pa.int64()), "items_sha256": [sha], "contaminated": [hit > 0]})

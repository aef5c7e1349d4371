"""Exact similarity join of texts on word n-grams, by rare-first prefix filtering.

Two texts are linked if the Jaccard similarity of their sets of distinct word n-grams is at least ``percent`` / 100. A
text's set: its distinct runs of n words; with fewer words, the whole sequence; without words, the empty set, which is
linked with nothing. n-grams are compared by 64-bit hashes, sets by 64 bits of a digest (their class).

1. sets: each text's size and class. Texts of one class are copies; from here on a class takes part once. A table of counts
   per range of hashes (2 ** SKETCH_BITS cells, summed up in a tree, whatever the input) gives the global order: n-grams of
   rarer cells first, then by another hash. Of all occurrences N, those of other n-grams in a cell vary by about
   sqrt(N / 2 ** SKETCH_BITS); an n-gram stands out if more classes have it. Any global order finds all links.
2. postings: each class sends the n-grams of its prefix, n - ceil(t n) + 1 of them, with its size and their positions,
   packed, to the buckets of their hashes. Linked classes share one at least. An n-gram that would fill a bucket by itself
   (a cell of DEAL classes above twice the mean) is dealt in blocks: classes are split into blocks, and each pair of blocks meets in a bucket of its own.
3. candidates: classes that share an n-gram, pass the length filter, and share so many n-grams of their prefixes, at such
   positions, that they can be linked (the positional filter). Where many share one n-gram, each is first paired with its
   nearest in size only.
4. verification: the candidates' sets are made once more (a Bloom filter of bounded size picks the texts), and each
   distinct pair is checked once: the suffix filter compares the numbers of n-grams in fixed ranges of hashes, and what
   passes is counted exactly. Groups of near copies with many pairs, and classes with many partners, are dealt to
   several parts, of PARTNERS pairs or so each.
5. components of the links found so far. In the n-grams that many share, pairs of different components that pass the
   filters are then checked as well, so that no link between components is left out; pairs inside one need no check. An
   n-gram of more than HOT classes is split into blocks by its exact count, and each pair of blocks is a group.

Nulls and empty texts: size 0, their own component. A component's id is the smallest doc_id in it; rows with a null id
take part, and have a null component only if all of it has. Rows that repeat an id and text are in one component; rows of
one id with other texts are rows of their own. Only the id and text columns are read; others may have any names. Sizes of buckets and parts follow the input; nothing that grows with it is broadcast or
collected.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import broadcast_if_small, fresh_name, small_enough, stored
from .components import components

NGRAM, PERCENT = 5, 75
SKETCH_BITS = 20
_SEGMENTS = 16
_TREE = 256
#: Classes of one n-gram up to which all pairs are candidates at once; beyond it, NEAR neighbours in size at first.
SMALL, NEAR = 48, 6
#: Classes of one n-gram (for postings: in its cell, beyond twice the mean) from which its postings are dealt in blocks; and
#: those, counted exactly, from which the pairs of its components are.
DEAL, HOT = 1 << 20, 20_000
BUCKET_BYTES, PART_BYTES = 16 << 20, 24 << 20
#: Pairs of one group of classes that are dealt to one part.
PARTNERS = 1024
BLOOM_BITS = (16, 28)
_SLICE = 4 << 20
_RANGES = 256
_U = np.uint64
#: n-grams of equal counts are ordered by their hash times this, so that the first ones lie in buckets of all ranges.
_TIES = _U(0x9E3779B97F4A7C15)


def _set_sizes_needed(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """The smallest intersection of linked sets of these sizes."""
    return -(-percent * (na + nb) // (100 + percent))


def _prefix_size(n, percent: int):
    return n - -(-percent * n // 100) + 1


def text_sets(data: np.ndarray, offs: np.ndarray, ngram: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    starts, ends, first = K.words(data, offs, K.SPACES)
    hashes = K.word_hashes(data, starts, ends)
    runs = K.grams(hashes, ngram)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= ngram:
            yield np.unique(runs[a : b - ngram + 1])
        elif b > a:
            yield K.grams(hashes[a:b], b - a)
        else:
            yield runs[:0]


def _class_of(grams: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def _cells(grams: np.ndarray) -> np.ndarray:
    return (grams >> _U(64 - SKETCH_BITS)).astype(np.int64)


def _described(docs: DataFrame, ngram: int, id_type: str) -> DataFrame:
    """(doc_id, n, class) for each row; and the task's table of counts, in segments (segment, task, cells)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        seen: set[int] = set()
        kind = None
        for batch in batches:
            kind = batch.column("doc_id").type
            sizes, classes = [], []
            for _, _, data, offs in K.slices(batch.column("text"), _SLICE):
                fresh = []
                for grams in text_sets(data, offs, ngram):
                    sizes.append(len(grams))
                    classes.append(_class_of(grams))
                    if len(grams) and classes[-1] not in seen:
                        seen.add(classes[-1])
                        fresh.append(grams)
                if fresh:
                    counts += np.bincount(_cells(np.concatenate(fresh)), minlength=len(counts)).astype(np.uint32)
            n = len(sizes)
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), none, none, pa.nulls(n, pa.binary())], ["doc_id", "n", "class", "segment", "task", "cells"])
        if kind is not None and seen:
            none, task = pa.nulls(_SEGMENTS, pa.int64()), TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.nulls(_SEGMENTS, kind), none, none, pa.array(range(_SEGMENTS), pa.int64()), pa.array([task] * _SEGMENTS, pa.int64()), pa.array([x.tobytes() for x in counts.reshape(_SEGMENTS, -1)], pa.binary())], ["doc_id", "n", "class", "segment", "task", "cells"])

    return docs.mapInArrow(run, f"doc_id {id_type}, n long, class long, segment long, task long, cells binary")


def _order_table(cells: DataFrame) -> np.ndarray:
    """The sum of the tasks' tables of counts: 2 ** SKETCH_BITS numbers, whatever the input. Sums _TREE tables at a time."""

    def run(group: pa.Table) -> pa.Table:
        total = np.zeros((1 << SKETCH_BITS) // _SEGMENTS, np.uint32)
        for x in group["cells"]:
            part = np.frombuffer(x.as_py(), np.uint32)
            total = np.minimum(total.astype(np.uint64) + part, np.uint64(2**32 - 1)).astype(np.uint32)
        return pa.table({"segment": group["segment"][:1], "task": pa.array([group["task"][0].as_py() // _TREE], pa.int64()), "cells": pa.array([total.tobytes()], pa.binary())})

    top = cells.agg(F.max("task")).first()[0]
    if top is None:
        return np.zeros(1 << SKETCH_BITS, np.uint32)
    while True:
        cells = cells.groupBy("segment", F.floor(F.col("task") / _TREE)).applyInArrow(run, "segment long, task long, cells binary")
        top //= _TREE
        if top == 0:
            break
        cells = stored(cells, "cells")
    rows = sorted(cells.collect(), key=lambda r: r["segment"])
    return np.concatenate([np.frombuffer(r["cells"], np.uint32) for r in rows])


def _packed(columns: dict[str, np.ndarray], bucket: np.ndarray) -> pa.RecordBatch:
    """One row per bucket, each column's values in one blob."""
    order = np.argsort(bucket, kind="stable")
    ids, at = np.unique(bucket[order], return_index=True)
    cut = np.append(at, len(order))
    arrays = [pa.array([v[order][a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()) for v in columns.values()]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *arrays], ["bucket", *columns])


def _postings(texts: DataFrame, order, deal: int, n_buckets: int, ngram: int, percent: int) -> DataFrame:
    """(bucket, gram, class, n, position), packed. Buckets are ranges of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = order.value
        seen: set[int] = set()
        for batch in batches:
            for _, _, data, offs in K.slices(batch.column(0), _SLICE):
                found: list[np.ndarray] = []
                names: list[int] = []
                sizes: list[int] = []
                weights: list[np.ndarray] = []
                for grams in text_sets(data, offs, ngram):
                    if not len(grams) or (name := _class_of(grams)) in seen:
                        continue
                    seen.add(name)
                    weight = counts[_cells(grams)]
                    first = np.lexsort((grams * _TIES, weight))[: _prefix_size(len(grams), percent)]
                    found.append(grams[first])
                    weights.append(weight[first])
                    names.append(name)
                    sizes.append(len(grams))
                if not found:
                    continue
                lengths = np.array([len(x) for x in found])
                gram, weight = np.concatenate(found), np.concatenate(weights)
                own = np.repeat(np.arange(len(found)), lengths)
                position = np.arange(len(gram)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                gram, own, position = _dealt(gram, own, position, weight, np.array(names, np.int64).view(_U), deal)
                bucket = ((gram >> _U(32)) * _U(n_buckets) >> _U(32)).astype(np.int64)
                yield _packed({"gram": gram, "class": np.array(names, np.int64)[own], "n": np.array(sizes, np.int32)[own], "position": position.astype(np.int32)}, bucket)

    return texts.mapInArrow(run, "bucket long, gram binary, class binary, n binary, position binary")


def _dealt(gram, own, position, weight, names, deal: int):
    """An n-gram of very many classes gets a hash for each pair of blocks that its class's block is in."""
    full = weight > deal
    if not full.any():
        return gram, own, position
    blocks = -(-weight[full].astype(np.int64) // deal)
    block = (K.mix(names[own[full]] + _U(77)) % blocks.astype(_U)).astype(np.int64)
    copies = np.repeat(np.flatnonzero(full), blocks)
    other = np.arange(len(copies)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    mine = np.repeat(block, blocks)
    pair = np.minimum(mine, other).astype(_U) << _U(32) | np.maximum(mine, other).astype(_U)
    fresh = K.mix(gram[copies] ^ K.mix(pair + _U(99)))
    return np.concatenate([gram[~full], fresh]), np.concatenate([own[~full], own[copies]]), np.concatenate([position[~full], position[copies]])


def _passing(i: np.ndarray, j: np.ndarray, n: np.ndarray, position: np.ndarray, percent: int) -> np.ndarray:
    """The length and the positional filter for pairs of postings of one n-gram."""
    ni, nj = n[i].astype(np.int64), n[j].astype(np.int64)
    longest = np.minimum(ni - position[i], nj - position[j])
    return (100 * np.minimum(ni, nj) >= percent * np.maximum(ni, nj)) & (longest >= _set_sizes_needed(ni, nj, percent))


_PAIR = {"a": np.int64, "b": np.int64, "shared": np.int32, "na": np.int32, "nb": np.int32, "ia": np.int32, "ib": np.int32}


def _candidates(postings: DataFrame, percent: int) -> DataFrame:
    """Pairs of a bucket (a < b) with the number of n-grams that they share in it, their sizes and the last shared positions,
    packed; and the postings of the n-grams that more than SMALL classes have."""

    def run(group: pa.Table) -> pa.Table:
        read = lambda name, kind: np.frombuffer(b"".join(group[name].to_pylist()), kind)
        gram, name, n, position = read("gram", _U), read("class", np.int64), read("n", np.int32), read("position", np.int32)
        order = np.lexsort((name, n, gram))
        gram, name, n, position = gram[order], name[order], n[order], position[order]
        once = np.ones(len(gram), bool)
        once[1:] = (gram[1:] != gram[:-1]) | (name[1:] != name[:-1])
        gram, name, n, position = gram[once], name[once], n[once], position[once]
        first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        size = np.diff(np.append(first, len(gram)))
        large = np.repeat(size > SMALL, size)
        found = []
        left = np.flatnonzero(np.repeat(size > 1, size))
        for k in range(1, int(size.max(initial=1))):
            i = left[left + k < len(gram)]
            i = i[gram[i] == gram[i + k]]
            if k > NEAR:
                i = i[~large[i]]
            if not len(i):
                break
            left = i
            i = i[100 * n[i].astype(np.int64) >= percent * n[i + k].astype(np.int64)]  # sizes ascend
            i = i[~large[i] | _passing(i, i + k, n, position, percent)]
            found.append(np.stack([i, i + k]))
        both = np.concatenate([np.zeros((2, 0), np.int64), *found], axis=1)
        both = np.where(name[both[0]] < name[both[1]], both, both[::-1])
        i, j = both[:, np.lexsort((name[both[1]], name[both[0]]))]
        head = np.flatnonzero(np.concatenate([[True], (name[i][1:] != name[i][:-1]) | (name[j][1:] != name[j][:-1])])) if len(i) else np.zeros(0, np.int64)
        over = lambda f, values: f.reduceat(values, head) if len(head) else values[:0]
        pairs = {"a": name[i][head], "b": name[j][head], "shared": over(np.add, (~large[i]).astype(np.int32)), "na": n[i][head], "nb": n[j][head], "ia": over(np.maximum, np.where(large[i], -1, position[i]).astype(np.int32)), "ib": over(np.maximum, np.where(large[j], -1, position[j]).astype(np.int32))}
        out = {"bucket": group["bucket"][:1]} | {c: [pairs[c].astype(k).tobytes()] for c, k in _PAIR.items()}
        out |= {"gram": [gram[large].tobytes()], "class": [name[large].tobytes()], "n": [n[large].tobytes()], "position": [position[large].tobytes()]}
        return pa.table(out)

    kinds = ", ".join(f"{c} binary" for c in [*_PAIR, "gram", "class", "n", "position"])
    return postings.groupBy("bucket").applyInArrow(run, f"bucket long, {kinds}")


def _possible(pairs: DataFrame, large: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs that can still be linked, given how many n-grams of their prefixes they share.

    What a pair shares beyond its prefixes is at most what the longer rest holds, and at most what follows the last shared
    positions. n-grams of many classes were not counted: each is taken as shared if both have as many.
    """
    total = pairs.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("na").alias("na"), F.max("nb").alias("nb"), F.max("ia").alias("ia"), F.max("ib").alias("ib"))
    many = large.groupBy("class").agg(F.count("*").alias("k"))
    total = total.join(many.select(F.col("class").alias("a"), F.col("k").alias("ka")), "a", "left").join(many.select(F.col("class").alias("b"), F.col("k").alias("kb")), "b", "left")
    more = F.least(F.coalesce("ka", F.lit(0)), F.coalesce("kb", F.lit(0)))
    need = F.ceil(percent * (F.col("na") + F.col("nb")) / (100 + percent) - 1e-9)
    rest = lambda n: F.ceil(percent * F.col(n) / 100 - 1e-9) - 1
    after = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) - 1
    by_rest = F.col("shared") + more + F.greatest(rest("na"), rest("nb")) >= need
    return total.where(by_rest & ((more > 0) | (F.col("shared") + after >= need))).select("a", "b")


def _unpacked(packed: DataFrame, kinds: dict[str, type]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                values = {c: np.frombuffer(batch.column(batch.schema.get_field_index(c))[row].as_py(), k).astype(np.int64) for c, k in kinds.items()}
                for i in range(0, len(next(iter(values.values()))), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(v[i : i + 100_000], pa.int64()) for v in values.values()], list(values))

    return packed.select(*kinds).mapInArrow(run, ", ".join(f"{c} long" for c in kinds))


def _bloom(ids: DataFrame, n: int):
    """A bit table of the ids' hashes (column h), of 2 ** BLOOM_BITS bits at most, made in segments."""
    bits = min(BLOOM_BITS[1], max(BLOOM_BITS[0], math.ceil(math.log2(max(1, 32 * n)))))
    segment_bits = bits - 8

    def run(group: pa.Table) -> pa.Table:
        own = np.zeros(1 << segment_bits, bool)
        own[group["bit"].to_numpy()] = True
        return pa.table({"segment": group["segment"][:1], "cells": [np.packbits(own).tobytes()]})

    place = F.shiftrightunsigned("h", 64 - bits)
    cells = ids.select(F.shiftright(place, segment_bits).alias("segment"), place.bitwiseAND(F.lit((1 << segment_bits) - 1)).alias("bit")).distinct()
    rows = cells.groupBy("segment").applyInArrow(run, "segment long, cells binary").collect()
    table = np.zeros(1 << bits, bool)
    for r in rows:
        table[r["segment"] << segment_bits : (r["segment"] + 1) << segment_bits] = np.unpackbits(np.frombuffer(r["cells"], np.uint8)).astype(bool)
    return ids.sparkSession.sparkContext.broadcast((bits, np.packbits(table)))


def _marked(hashes: np.ndarray, bits: int, table: np.ndarray) -> np.ndarray:
    place = (hashes.view(_U) >> _U(64 - bits)).astype(np.int64)
    return ((table[place >> 3] >> (7 - (place & 7))) & 1).astype(bool)


def _in_bloom(documents: DataFrame, bloom, id_col: str, inside: bool) -> DataFrame:
    """The rows whose id is (or is not) in the filter, all columns as they are."""
    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marked = _marked(batch.column(len(names)).to_numpy(), *bloom.value)
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], names).filter(pa.array(marked == inside))

    return documents.select("*", F.xxhash64(id_col)).mapInArrow(run, documents.schema)


def _sets_of(docs: DataFrame, bloom, ngram: int) -> DataFrame:
    """(class, ranges, grams) of the rows whose id is in the filter; once per task and class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, table = bloom.value
        seen: set[int] = set()
        for batch in batches:
            texts = batch.column("text").filter(pa.array(_marked(batch.column("h").to_numpy(), bits, table)))
            for _, _, data, offs in K.slices(texts):
                names, sets = [], []
                for grams in text_sets(data, offs, ngram):
                    if len(grams) and (name := _class_of(grams)) not in seen:
                        seen.add(name)
                        names.append(name)
                        sets.append(grams)
                if names:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([_ranges(s).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["class", "ranges", "grams"])

    return docs.select(F.xxhash64("doc_id").alias("h"), "text").mapInArrow(run, "class long, ranges binary, grams binary")


def linked(x: np.ndarray, y: np.ndarray, percent: int, ranges_x: np.ndarray, ranges_y: np.ndarray) -> bool:
    """The suffix filter (no more can be shared than both have in each range of hashes), then the exact count."""
    need = int(_set_sizes_needed(np.int64(len(x)), np.int64(len(y)), percent))
    if max(len(x), len(y)) < 1 << 16 and int(np.minimum(ranges_x, ranges_y).sum()) < need:
        return False
    if len(x) > len(y):
        x, y = y, x
    place = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int((y[place] == x).sum()) >= need


def _ranges(grams: np.ndarray) -> np.ndarray:
    """How many n-grams lie in each of the ranges of hashes; meaningful for sets of fewer than 65,536."""
    return np.bincount((grams >> _U(56)).astype(np.int64), minlength=_RANGES).astype(np.uint16)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked. Each is checked in the part of the smallest partner of a, which the pairs of a group
    of near copies have in common; a class's set goes to each part once. Large groups are dealt by a to several parts, and
    the pairs of an a with many partners by b."""
    bytes_ = sets.agg(F.sum(F.length("grams") + 64)).first()[0] or 0
    parts = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(4 * bytes_ / PART_BYTES))
    both = pairs.select("a", "b").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = pairs.join(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("hub")), "a")
    many = lambda by, name: near.groupBy(by).agg(F.ceil(F.count("*") / PARTNERS).alias(name)).where(F.col(name) > 1)
    salt = lambda c, k: F.pmod(F.xxhash64(c), F.coalesce(k, F.lit(1)))
    dealt = near.join(many("hub", "k"), "hub", "left").join(many("a", "ka"), "a", "left").select("a", "b", F.pmod(F.xxhash64("hub", salt("a", "k"), salt("b", "ka")), F.lit(parts)).alias("part"))
    dealt = stored(dealt, "pairs")
    asked = stored(dealt.select("part", F.col("a").alias("class")).unionAll(dealt.select("part", F.col("b").alias("class"))).distinct(), "asked")
    sent = broadcast_if_small(asked, 64).join(sets.select("class", "grams"), "class").select(F.col("part").alias("place"), "class", "grams")

    def run(key, own: pa.Table, given: pa.Table) -> pa.Table:
        known = {}
        for name, grams in zip(given["class"].to_pylist(), given["grams"].to_pylist(), strict=True):
            if name not in known:
                values = np.frombuffer(grams, _U)
                known[name] = (values, _ranges(values))
        a, b = own["a"].to_pylist(), own["b"].to_pylist()
        keep = [i for i, (x, y) in enumerate(zip(a, b, strict=True)) if linked(known[x][0], known[y][0], percent, known[x][1], known[y][1])]
        return pa.table({"a": pa.array([a[i] for i in keep], pa.int64()), "b": pa.array([b[i] for i in keep], pa.int64())})

    return dealt.groupBy("part").cogroup(sent.groupBy("place")).applyInArrow(run, "a long, b long")


def _across(large: DataFrame, ranges: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different roots among the postings of one n-gram that pass the length, positional and suffix filters.

    large: (gram, class, n, position, root). n-grams of one root only are left out before anything is sent. Those of more
    than HOT classes are split: classes fall into blocks, and each pair of blocks is a group of its own.
    """
    sizes = large.groupBy("gram").agg(F.ceil(F.count("*") / HOT).alias("k"), F.min("root").alias("least"), F.max("root").alias("most"))
    own = large.join(sizes.where("least <> most").select("gram", "k"), "gram").withColumn("block", F.pmod(F.xxhash64("class"), F.col("k")))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    own = own.select("gram", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "class", "n", "position", "root").join(ranges, "class")

    def run(group: pa.Table) -> pa.Table:
        name, n, position, root, block = (group[c].to_numpy() for c in ("class", "n", "position", "root", "block"))
        roots, inverse, counts = np.unique(root, return_inverse=True, return_counts=True)
        none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        split = group["low"][0].as_py() != group["high"][0].as_py()  # pairs of one block are made by its own group
        if len(roots) == 1 or split and (block == block[0]).all():
            return none
        order = np.lexsort((name, n))
        name, n, position, inverse, block = name[order], n[order], position[order], inverse[order], block[order]
        ranges = np.frombuffer(b"".join(group["ranges"].to_pylist()), np.uint16).reshape(-1, _RANGES)[order]
        major = counts.argmax()
        pairs = [np.zeros((0, 2), np.int64)]
        for i in np.flatnonzero(inverse != major):
            j = np.arange(*np.searchsorted(n, [-(-n[i] * percent // 100), n[i] * 100 // percent + 1]))
            # pairs of two minor ones are met twice, and made once
            j = j[(inverse[j] != inverse[i]) & ((inverse[j] == major) | (j > i)) & ((block[j] != block[i]) | (not split))]
            j = j[_passing(np.full(len(j), i), j, n, position, percent)]
            both = np.minimum(ranges[j], ranges[i]).sum(axis=1, dtype=np.int64)
            j = j[(both >= _set_sizes_needed(n[i], n[j], percent)) | (np.maximum(n[i], n[j]) >= 1 << 16)]
            if len(j):
                pairs.append(np.sort(np.stack([np.full(len(j), name[i]), name[j]], axis=1), axis=1))
        both = np.concatenate(pairs)
        return pa.table({"a": both[:, 0], "b": both[:, 1]})

    return own.groupBy("gram", "low", "high").applyInArrow(run, "a long, b long")


def _links(documents: DataFrame, id_col: str, text_col: str, ngram: int, percent: int, bucket_bytes: int, every: bool) -> tuple[DataFrame, DataFrame, DataFrame | None, DataFrame | None]:
    """Rows (doc_id, n, class), classes (class, first, n), links (a, b) of classes and their components (node, root); the
    last two None without words. every: all links, and no components; else as many as make the components exact."""
    spark = documents.sparkSession
    docs = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    described = stored(_described(docs, ngram, id_type), "described")
    rows = described.where("segment is null").select("doc_id", "n", "class")
    classes = stored(rows.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("first"), F.first("n").alias("n")), "classes")
    size = classes.agg(F.sum("n").alias("grams"), F.count("*").alias("n")).first()
    if not size["n"]:
        return rows, classes, None, None
    order = spark.sparkContext.broadcast(_order_table(described.where("segment is not null").select("segment", "task", "cells")))
    per_gram = 24 * (100 - percent) / 100
    n_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((size["grams"] * per_gram + 24 * size["n"]) / bucket_bytes))
    postings = _postings(docs.select("text"), order, DEAL + 2 * (size["grams"] >> SKETCH_BITS), n_buckets, ngram, percent)
    found = stored(_candidates(postings, percent), "candidates")
    large = _unpacked(found, {"gram": np.int64, "class": np.int64, "n": np.int32, "position": np.int32})
    pairs = stored(_possible(_unpacked(found, _PAIR), large, percent), "pairs")
    wanted = pairs.select(F.col("a").alias("class")).unionAll(pairs.select(F.col("b").alias("class"))).unionAll(large.select("class")).distinct()
    ids = stored(wanted.join(classes, "class").select(F.xxhash64("first").alias("h")), "ids")
    sets = stored(_sets_of(docs, _bloom(ids, ids.count()), ngram), "sets")  # rarely, a class has two rows
    links = stored(_verified(pairs, sets, percent), "links")
    roots = None if every else stored(components(links), "roots")
    if every:  # each class by itself, so that _across() makes the pairs inside a component too
        named = large.withColumn("root", F.col("class"))
    else:
        named = large.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    ranges = sets.select("class", "ranges").dropDuplicates(["class"])
    more = stored(_across(named, ranges, percent).distinct().join(pairs, ["a", "b"], "left_anti"), "more")
    if more.limit(1).count():
        links = links.unionAll(_verified(more, sets, percent))
        roots = None if every else stored(components(links), "roots")
    return rows, classes, links, roots


def jaccard_links(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM, percent: int = PERCENT, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per document row: its id, n_shingles, class (of equal sets; null without words) and n_links, the number of
    other classes it is linked with. Every pair of classes that shares an n-gram of a prefix and passes the filters is
    checked, inside components too: in a group of k near copies about k * k / 2 pairs."""
    rows, classes, links, _ = _links(documents, id_col, text_col, ngram, percent, bucket_bytes, every=True)
    none = F.lit(0).cast("long").alias("n_links")
    n = F.col("n").alias("n_shingles")
    if links is None:
        return rows.select("doc_id", n, F.lit(None).cast("long").alias("class"), none)
    links = links.distinct()
    ends = links.select(F.col("a").alias("class")).unionAll(links.select(F.col("b").alias("class")))
    classes = classes.select("class").join(ends.groupBy("class").agg(F.count("*").alias("n_links")), "class", "left")
    out = rows.where("n > 0").join(classes, "class").select("doc_id", n, "class", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return out.unionAll(rows.where("n = 0").select("doc_id", n, F.lit(None).cast("long").alias("class"), none))


def _with_roots(documents: DataFrame, id_col: str, text_col: str, ngram: int, percent: int, bucket_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n, class), and classes (class, first, root): the smallest id of a class, and its component."""
    rows, classes, _, roots = _links(documents, id_col, text_col, ngram, percent, bucket_bytes, every=False)
    if roots is None:
        return rows, classes.select("class", "first", F.col("class").alias("root"))
    return rows, classes.join(roots.withColumnRenamed("node", "class"), "class", "left").select("class", "first", F.coalesce("root", "class").alias("root"))


def jaccard_components(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM, percent: int = PERCENT, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per document row: its id, n_shingles, component_id."""
    rows, classes = _with_roots(documents, id_col, text_col, ngram, percent, bucket_bytes)
    firsts = classes.where("class <> root").select("root").distinct().join(classes, "root").groupBy("root").agg(F.min("first").alias("least"))
    named = classes.join(firsts, "root", "left").select("class", F.coalesce("least", "first").alias("component_id"))
    out = rows.where("n > 0").join(named, "class").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionAll(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def deduplicate(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM, percent: int = PERCENT, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row of each component, and all rows without words; all columns as they are.

    It is a row of the smallest id, null ids last. Rows are told apart by id and class, never by the id alone: of rows that
    repeat an id, those with texts of other components are looked at by themselves. Of several rows of the smallest id, the
    one of the smallest class stays, and of rows that repeat that as well the one with the smallest text and columns.
    """
    rows, classes = _with_roots(documents, id_col, text_col, ngram, percent, bucket_bytes)
    best = classes.groupBy("root").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "class")).alias("best"))
    best = best.select(F.col("best.class").alias("class"), F.lit(True).alias("stays"))
    marked = classes.select("class", "first").join(best, "class", "left")
    told = stored(rows.where("n > 0").groupBy("doc_id", "class").agg(F.count("*").alias("n")).join(marked, "class").select("doc_id", "class", "n", (F.col("stays").isNotNull() & F.col("doc_id").eqNullSafe(F.col("first"))).alias("stays")), "told")
    gone = told.where("not stays").select("doc_id", "class")
    again = told.where("stays and n > 1").select("doc_id", "class")
    asked = gone.unionAll(again).select("doc_id").distinct()
    # most rows are cleared by id: by a small table, or else by a bit table of bounded size; classes are made of the others
    asked = stored(asked, "asked")
    ids, mark = fresh_name("_id", documents.columns), fresh_name("_class", documents.columns)
    if small_enough(asked, 64):
        known, same = F.broadcast(asked.select(F.col("doc_id").alias(ids))), F.col(id_col).eqNullSafe(F.col(ids))
        clear, unclear = documents.join(known, same, "left_anti"), documents.join(known, same, "left_semi")
    else:
        bloom = _bloom(asked.select(F.xxhash64("doc_id").alias("h")), asked.count())
        clear, unclear = (_in_bloom(documents, bloom, id_col, inside) for inside in (False, True))
    unclear = _classed(unclear, text_col, ngram, mark)
    other = fresh_name("_other", documents.columns)
    gone, again = (t.select(F.col("doc_id").alias(ids), F.col("class").alias(other)) for t in (gone, again))
    same = F.col(id_col).eqNullSafe(F.col(ids)) & (F.col(mark) == F.col(other))
    kept = unclear.join(gone, same, "left_anti")
    if not again.limit(1).count():
        return clear.unionAll(kept.drop(mark))
    once, twice = kept.join(again, same, "left_anti"), kept.join(again, same, "left_semi")
    hashable = [f.name for f in documents.schema if "map<" not in f.dataType.simpleString()]
    whole = F.struct(*documents.columns)
    one = twice.groupBy(id_col, mark).agg(F.min_by(whole, F.struct(F.col(text_col), F.xxhash64(*hashable))).alias(other)).select(f"{other}.*")
    return clear.unionAll(once.drop(mark)).unionAll(one)


def _classed(documents: DataFrame, text_col: str, ngram: int, name: str) -> DataFrame:
    """The documents with the class of their text (0 without words) as a last column."""
    last = len(documents.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, _, data, offs in K.slices(batch.column(last), _SLICE):
                found += [_class_of(grams) if len(grams) else 0 for grams in text_sets(data, offs, ngram)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(found, pa.int64())], batch.schema.names)

    texts = documents.select("*", F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(name))
    return texts.mapInArrow(run, documents.select("*", F.lit(0).cast("long").alias(name)).schema)

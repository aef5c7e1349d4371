"""SentencePiece encoding and decoding by a batched numpy Viterbi search.

A text gets one leading space and is cut before each run of spaces, as no piece has a space after another character
(models for which that fails are refused). Each distinct word of a slice is segmented once. Words of equal length advance
together: the hashes of all their substrings of up to the longest piece's length are looked up among the sorted hashes of
the pieces, and at each position the maximum over the candidate last pieces stores the backpointer.

A long word, as text without spaces is, is cut into chunks that overlap and advance together as well. What the search has at
a position depends on the positions before it only as far back as the longest piece is long; so from where a chunk agrees
with the one before it at so many positions in a row, its results are those of the whole word. A chunk that does not come to
agree within the overlap is searched again from where the word is known, which is rare but for some periodic texts.

The score of a candidate depends on the model's kind:
* unigram: the best score of the text before it plus the piece's own score (the longer last piece among equals);
* BPE: 0 if the best last piece before it and the piece stay as they are when the merges are applied to the two of them,
  minus infinity otherwise. A segmentation is the one the merges make if and only if that holds for all its neighbours,
  so the search returns exactly the merges' result. What the merges make of two pieces is worked out once per pair.

Characters without a piece become their UTF-8 bytes' pieces. Ids equal those of the SentencePiece library with the same
model (identity normaliser). Decoding gives the text back exactly, but for U+2581, which the format itself uses for the
space. Null and empty texts have no ids; repeated rows give repeated results, an empty table an empty one. Columns are
taken by name only where they are asked for; others are ignored, whatever they are called. Memory is bounded by the slice,
or the longest text.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .token_counts import broadcast_file

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
_SPACE = "▁"
_NORMAL, _BYTE = 1, 6
_UNIGRAM, _BPE = 1, 2
_CELLS = 1 << 17
#: Words of more characters than these two are cut into chunks, each with an overlap after it.
CHUNK, OVERLAP = 1260, 260
SLICE_BYTES = 2 << 20
#: Pieces decoded at once.
DECODE_PIECES = 1 << 18
#: Bounds of what a worker remembers between slices: segmented words (of at most 64 bytes) and pairs of pieces.
WORD_MEMO, PAIR_MEMO = 1 << 19, 1 << 20
_NONE = -1


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol buffer message: number and value (int, bytes, or float of 4 bytes)."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield key >> 3, struct.unpack("<f" if n == 4 else "<d", data[at : at + n])[0]
            at += n


class Model:
    """Pieces, scores and kinds of a model file, with the tables for encoding and decoding."""

    def __init__(self, raw: bytes):
        pieces, scores, kinds, self.kind = [], [], [], _UNIGRAM
        for number, value in _fields(raw):
            if number == 1:
                own = dict(_fields(value))
                pieces.append(own[1].decode())
                scores.append(own.get(2, 0.0))
                kinds.append(own.get(3, _NORMAL))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, _UNIGRAM)
        self.pieces, self.scores = pieces, np.array(scores, np.float64)
        normal = [i for i, k in enumerate(kinds) if k == _NORMAL]
        if self.kind not in (_UNIGRAM, _BPE) or any(_SPACE in p.lstrip(_SPACE) for p in (pieces[i] for i in normal)):
            raise ValueError("models of this kind are not supported")
        self.id_of = {pieces[i]: i for i in normal}
        self.byte_ids = np.full(256, _NONE, np.int32)
        for i, k in enumerate(kinds):
            if k == _BYTE:
                self.byte_ids[int(pieces[i][3:5], 16)] = i
        if (self.byte_ids < 0).any():
            raise ValueError("models without byte pieces are not supported")
        self.unknown = len(pieces)  # one character without a piece
        self.unknown_score = self.scores[normal].min() - 10.0
        self.start = self.unknown + 1  # stands before a word
        self.lengths = np.array([*map(len, pieces), 1, 0])
        self.weights = np.append(self.scores, self.unknown_score)
        self._pairs, self._kept = np.full(PAIR_MEMO, -1, np.int64), np.zeros(PAIR_MEMO, bool)
        self._forget()
        if self.kind == _BPE:
            normal = [i for i in normal if self._merged(pieces[i]) == [i]]
        self.longest = max(len(pieces[i]) for i in normal)
        keys = np.array([_text_hash(pieces[i]) for i in normal], np.uint64)
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], np.array(normal, np.int32)[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        #: What each piece stands for, for decoding.
        text = [bytes([int(p[3:5], 16)]) if k == _BYTE else p.replace(_SPACE, " ").encode() if k == _NORMAL else b"" for p, k in zip(pieces, kinds, strict=True)]
        self.piece_bytes = np.frombuffer(b"".join(text), np.uint8)
        self.piece_starts = np.concatenate([[0], np.cumsum([len(t) for t in text])])

    def _forget(self) -> None:
        self._words, self._places = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._ids, self._at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _merged(self, text: str) -> list[int]:
        """The merges, step by step: the pair with the best score, the leftmost first among equals."""
        part = list(text)
        before, after = list(range(-1, len(part) - 1)), [*range(1, len(part)), -1]
        heap: list[tuple[float, int, str, int]] = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else -1
            if i >= 0 and j >= 0 and (k := self.id_of.get(part[i] + part[j])) is not None:
                heapq.heappush(heap, (-self.scores[k], i, part[i] + part[j], j))

        for i in range(len(part) - 1):
            offer(i)
        while heap:
            _, i, joint, j = heapq.heappop(heap)
            if not part[i] or not part[j] or after[i] != j or part[i] + part[j] != joint:
                continue
            part[i], part[j] = joint, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [self.id_of.get(p, self.unknown) for p in part if p]

    def _stays(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the merges leave each pair of pieces as it is. Pairs with an unknown character or the start always stay."""
        pairs = left.astype(np.int64) * (self.start + 1) + right
        place = (K.mix(pairs.astype(np.uint64)) % np.uint64(len(self._pairs))).astype(np.int64)
        found = self._kept[place]
        fresh = np.flatnonzero(self._pairs[place] != pairs)
        if len(fresh):
            new, inverse = np.unique(pairs[fresh], return_inverse=True)
            made = []
            for a, b in zip(*(x.tolist() for x in np.divmod(new, self.start + 1)), strict=True):
                made.append(max(a, b) >= self.unknown or self._merged(self.pieces[a] + self.pieces[b]) == [a, b])
            found[fresh] = np.array(made)[inverse]
            self._pairs[place[fresh]], self._kept[place[fresh]] = pairs[fresh], found[fresh]
        return found

    def _lookup(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(hashes.shape, _NONE, np.int32)
        at = np.nonzero(self.seen[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        own = hashes[at]
        place = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        out[at] = np.where(self.keys[place] == own, self.key_ids[place], _NONE)
        return out

    def _search(self, points: np.ndarray, known: tuple[np.ndarray, ...] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of words of one length (rows of code points), for each prefix: its best score, its last piece and that one's length.
        known: these three of the first prefixes, for words that are searched on from there."""
        count, length = points.shape
        most = min(self.longest, length)
        power, inverse = K._power_tables(length)
        sums = np.zeros((count, length + 1), np.uint64)
        np.cumsum(K.mix(points.astype(np.uint64) + np.uint64(1)) * power[:length], axis=1, out=sums[:, 1:])
        pieces = np.full((length + 1, most, count), _NONE, np.int32)  # by end and length, the longest first
        for n in range(1, most + 1):
            ids = self._lookup((sums[:, n:] - sums[:, : length + 1 - n]) * inverse[: length + 1 - n])
            pieces[n:, most - n] = (np.where(ids < 0, self.unknown, ids) if n == 1 else ids).T
        best, last, step = np.full((count, length + 1), -np.inf), np.full((count, length + 1), _NONE, np.int32), np.zeros((count, length + 1), np.int32)
        best[:, 0], last[:, 0] = 0.0, self.start
        begin = 1
        if known is not None:
            begin = known[0].shape[1]
            best[:, :begin], last[:, :begin], step[:, :begin] = known
        rows = np.arange(count)
        for i in range(begin, length + 1):
            own = pieces[i]
            at, row = np.nonzero(own >= 0)
            ids, j = own[at, row], i - most + at
            score = best[row, j]
            if self.kind == _UNIGRAM:
                score = score + self.weights[ids]
            else:
                score[~self._stays(last[row, j], ids)] = -np.inf
            table = np.full((most, count), -np.inf)
            table[at, row] = score
            pick = table.argmax(axis=0)
            best[:, i], last[:, i], step[:, i] = table[pick, rows], own[pick, rows], most - pick
        return best, last, step

    def _viterbi(self, points: np.ndarray) -> np.ndarray:
        """Piece ids of words of one length, left-aligned, the rest filled with _NONE."""
        count, length = points.shape
        _, last, step = self._search(points)
        out = np.full((count, length), _NONE, np.int32)
        at, size = np.full(count, length), np.zeros(count, np.int64)
        rows = np.arange(count)
        while len(rows):
            out[rows, size[rows]] = last[rows, at[rows]]
            size[rows] += 1
            at[rows] -= step[rows, at[rows]]
            rows = rows[at[rows] > 0]
        column = np.arange(length)[None, :]
        back = np.where(column < size[:, None], size[:, None] - 1 - column, 0)
        return np.where(column < size[:, None], np.take_along_axis(out, back, axis=1), _NONE)

    def _long(self, points: np.ndarray) -> np.ndarray:
        """Piece ids of one long word, chunk by chunk (see above)."""
        n = len(points)
        overlap = max(OVERLAP, 2 * self.longest)
        width = CHUNK + overlap
        heads = np.arange(0, n, CHUNK)
        padded = np.zeros(heads[-1] + width, points.dtype)
        padded[:n] = points
        best, last, step = np.zeros(n + 1), np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int32)
        some = max(1, _CELLS // width)
        for k, s in enumerate(heads.tolist()):
            if k % some == 0:
                chunks = self._search(padded[heads[k : k + some, None] + np.arange(width)])
            own = [x[k % some] for x in chunks]
            end = min(n, s + width)
            have = min(n, s + overlap)  # so far the word is known
            sure = 0 if k == 0 else self._agree(best[s + 1 : have + 1], last[s + 1 : have + 1], own[0][1 : have - s + 1], own[1][1 : have - s + 1])
            if sure < 0:
                back = have - self.longest
                made = self._search(points[None, back:end], tuple(x[None, back : have + 1] for x in (best, last, step)))
                for whole, x in zip((best, last, step), made, strict=True):
                    whole[have + 1 : end + 1] = x[0, self.longest + 1 :]
            else:
                gap = best[s + sure] - own[0][sure] if k else 0.0
                best[s + sure : end + 1] = own[0][sure : end - s + 1] + gap
                last[s + sure : end + 1], step[s + sure : end + 1] = own[1][sure : end - s + 1], own[2][sure : end - s + 1]
        marks = np.zeros(n + 1, bool)
        i = n
        for a in range((n - 1) // _CELLS * _CELLS, -1, -_CELLS):
            sizes = step[a + 1 : a + _CELLS + 1].tolist()
            while i > a:
                marks[i] = True
                i -= sizes[i - a - 1]
        return last[marks]

    def _agree(self, best: np.ndarray, last: np.ndarray, own_best: np.ndarray, own_last: np.ndarray) -> int:
        """The first position (from 1) up to which a chunk agrees with the word at as many in a row as the longest piece is
        long: in the last piece, and in the score but for a constant. -1 if there is none."""
        same = last == own_last
        if self.kind == _UNIGRAM:
            same &= np.abs(np.diff(best - own_best, prepend=best[0] - own_best[0])) < 1e-6
        bad = np.concatenate([[-1], np.flatnonzero(~same), [len(same)]])
        runs = np.flatnonzero(np.diff(bad) - 1 > self.longest)
        return int(bad[runs[0]] + 2 + self.longest) if len(runs) else -1

    def encode_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words data[start:end] (UTF-8, space as 0x20), one after the other, and where each word's begin."""
        sizes = ends - starts
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        flat = data[np.arange(bounds[-1]) - np.repeat(bounds[:-1], sizes) + np.repeat(starts, sizes)]
        points = np.frombuffer(flat.tobytes().decode().encode("utf-32-le"), np.uint32)
        points = np.where(points == 0x20, np.uint32(ord(_SPACE)), points)
        heads = np.concatenate([[0], np.cumsum((flat & 0xC0) != 0x80)])
        first = heads[bounds]
        lengths = np.diff(first)
        out: list[np.ndarray | None] = [None] * len(lengths)
        order = np.argsort(lengths, kind="stable")
        i = 0
        while i < len(order):
            length = int(lengths[order[i]])
            if length > CHUNK + OVERLAP:
                out[order[i]] = self._long(points[first[order[i]] : first[order[i]] + length])
                i += 1
                continue
            same = int(np.searchsorted(lengths[order], length, side="right"))
            j = min(same, i + max(1, _CELLS // max(1, length)))
            rows = order[i:j]
            ids = self._viterbi(points[first[rows][:, None] + np.arange(length)])
            for w, row, n in zip(rows.tolist(), ids, (ids >= 0).sum(axis=1).tolist(), strict=True):
                out[w] = row[:n]
            i = j
        for w, ids in enumerate(out):
            if ids.max(initial=0) == self.unknown:
                chars = points[first[w] : first[w + 1]]
                out[w] = self._with_bytes(ids, chars)
        flat_ids = np.concatenate(out) if out else np.zeros(0, np.int32)
        return flat_ids, np.concatenate([[0], np.cumsum([len(x) for x in out], dtype=np.int64)])

    def _with_bytes(self, ids: np.ndarray, points: np.ndarray) -> np.ndarray:
        """The ids with each unknown character replaced by its bytes' pieces."""
        raw = np.frombuffer(points.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        heads = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        unknown = ids == self.unknown
        chars = np.concatenate([[0], np.cumsum(self.lengths[ids])])[:-1][unknown]
        sizes = np.ones(len(ids), np.int64)
        sizes[unknown] = heads[chars + 1] - heads[chars]
        out = np.repeat(ids, sizes)
        at = np.repeat(heads[chars] - np.concatenate([[0], np.cumsum(sizes[unknown])])[:-1], sizes[unknown]) + np.arange(sizes[unknown].sum())
        out[out == self.unknown] = self.byte_ids[raw[at]]
        return out

    def _remembered(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words (sorted keys): a flat array, and where in it each word's ids begin and how many there are."""
        place = np.minimum(np.searchsorted(self._words, keys), max(0, len(self._words) - 1))
        known = self._words[place] == keys if len(self._words) else np.zeros(len(keys), bool)
        fresh = np.flatnonzero(~known)
        begin, size = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        flat, bounds = self._ids, self._at
        if known.any():
            own = self._places[place[known]]
            begin[known], size[known] = bounds[own], bounds[own + 1] - bounds[own]
        if len(fresh):
            ids, at = self.encode_words(data, starts[fresh], ends[fresh])
            begin[fresh], size[fresh] = len(flat) + at[:-1], np.diff(at)
            if len(self._words) + len(fresh) > WORD_MEMO:
                self._forget()
            else:
                base = len(self._at) - 1
                short = np.flatnonzero(ends[fresh] - starts[fresh] <= 64)
                sites = np.searchsorted(self._words, keys[fresh][short])
                self._words = np.insert(self._words, sites, keys[fresh][short])
                self._places = np.insert(self._places, sites, base + short)
                self._at = np.concatenate([bounds, len(flat) + at[1:]])
                self._ids = np.concatenate([flat, ids])
            flat = np.concatenate([flat, ids])
        return flat, begin, size

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts (UTF-8 bytes and offsets), one after the other, and where each text's begin."""
        sizes = np.diff(offs)
        extra = np.concatenate([[0], np.cumsum(sizes > 0)])
        spaced = np.empty(len(data) + extra[-1], np.uint8)
        begins = (offs + extra)[:-1][sizes > 0]
        mask = np.ones(len(spaced), bool)
        mask[begins] = False
        spaced[begins] = 0x20
        spaced[mask] = data
        space = spaced == 0x20
        start = space.copy()
        start[1:] &= ~space[:-1]
        start[begins] = True
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(spaced))
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        keys, one, inverse = np.unique(K.word_hashes(spaced, starts, ends, K.EXACT), return_index=True, return_inverse=True)
        ids, at, sizes = self._remembered(keys, spaced, starts[one], ends[one])
        counts = sizes[inverse]
        total = np.concatenate([[0], np.cumsum(counts)])
        flat = ids[np.arange(total[-1]) + np.repeat(at[inverse] - total[:-1], counts)]
        return flat, total[np.searchsorted(starts, offs + extra)]

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes and offsets of the texts of ids; the leading space is taken away."""
        parts, bounds, base, i = [np.zeros(0, np.uint8)], np.zeros(len(offs), np.int64), 0, 0
        while i < len(offs) - 1:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + DECODE_PIECES, side="right")) - 1)
            own = ids[offs[i] : offs[j]]
            first = self.piece_starts[own]
            sizes = self.piece_starts[own + 1] - first
            total = np.concatenate([[0], np.cumsum(sizes)])
            parts.append(self.piece_bytes[np.arange(total[-1]) + np.repeat(first - total[:-1], sizes)])
            bounds[i + 1 : j + 1] = base + total[offs[i + 1 : j + 1] - offs[i]]
            base, i = base + int(total[-1]), j
        flat = np.concatenate(parts)
        lead = bounds[:-1][bounds[1:] > bounds[:-1]]
        lead = lead[flat[lead] == 0x20]
        mask = np.ones(len(flat), bool)
        mask[lead] = False
        return flat[mask], bounds - np.searchsorted(lead, bounds)


def _text_hash(piece: str) -> int:
    """The hash that _viterbi() has of this substring."""
    points = np.frombuffer(piece.encode("utf-32-le"), np.uint32).astype(np.uint64)
    return int((K.mix(points + np.uint64(1)) * K._power_tables(len(points))[0][: len(points)]).sum(dtype=np.uint64))


_models: dict[bytes, Model] = {}


def model_of(raw: bytes) -> Model:
    key = hashlib.sha256(raw).digest()
    if key not in _models:
        _models[key] = Model(raw)
    return _models[key]


def encode(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = MODEL_PATH, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document row: its id, the columns to carry along, n_pieces, ids, and round_trip (whether decoding gives the
    text back)."""
    raw = broadcast_file(documents.sparkSession, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(raw.value)
        for batch in batches:
            for i, j, data, offs in K.slices(batch.column(0), SLICE_BYTES):
                ids, at = model.encode(data, offs)
                back, back_offs = model.decode(ids, at)
                if len(back) == len(data) and (back_offs == offs).all():
                    wrong = np.concatenate([[0], np.cumsum(back != data)])
                    same = wrong[offs[1:]] == wrong[offs[:-1]]
                else:
                    same = np.array([bytes(back[a:b]) == bytes(data[c:d]) for a, b, c, d in zip(back_offs[:-1], back_offs[1:], offs[:-1], offs[1:], strict=True)])
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                kept = batch.slice(i, j - i).columns[1:]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(at), pa.int64()), lists, pa.array(same, pa.bool_())], names)
                K.give_back()

    docs = documents.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("doc_id"), *carry)
    names = ["doc_id", *carry, "n_pieces", "ids", "round_trip"]
    schema = docs.select(*[F.col(c) for c in names[:-3]], F.lit(0).cast("long").alias("n_pieces"), F.array().cast("array<int>").alias("ids"), F.lit(True).alias("round_trip")).schema
    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model_path: str = MODEL_PATH) -> DataFrame:
    """One row per row: its id and text. A null list is the empty text; bytes that are no UTF-8 become U+FFFD."""
    raw = broadcast_file(encoded.sparkSession, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(raw.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                lists = [x or [] for x in part.column("ids").to_pylist()]
                offs = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)])
                data, at = model.decode(np.array([k for x in lists for k in x], np.int64), offs)
                texts = [data[a:b].tobytes().decode(errors="replace") for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")

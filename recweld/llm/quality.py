"""Document quality by attention-based multiple-instance learning.

A text is a bag of passages of PASSAGE_WORDS words. Each passage is described by the frequencies of pairs of byte classes
and a few shares (repeated word runs, distinct words, length), and encoded by a learned layer. Gated attention weighs the
passages: a_k is the softmax over k of w.(tanh(V h_k) * logistic(U h_k)); the weighted representation gives the score.
Encoder, attention and classifier are trained together by gradient descent on document labels only.

Training sees a bounded sample of labelled documents (SAMPLE_DOCS per class, and SAMPLE_BYTES of text) and all passages of
their whole texts; the sampled ids are all that is broadcast. Every passage of every document is scored.

Null and empty texts are one passage without words. Labels of null quality or of ids without a document are not used;
repeated labels count repeatedly, repeated rows of a document once in training. Without labels of both classes the score is
the share of label 1 (0.5 without any). Equal texts get equal scores. An empty table gives an empty result; columns other
than the id, text and label are not read, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel as K

PASSAGE_WORDS = 48
SAMPLE_DOCS, SAMPLE_BYTES = 1000, 16 << 20
UNITS, ATTENTION = 12, 8
STEPS, BATCH = 500, 64
THRESHOLD = 0.7
_CLASSES = 12
#: Byte classes: lower case, upper case, digits, blank, line end, comma and stop, brackets and quotes, other marks, symbols, pipe, bytes above ASCII, control.
_CLASS = np.full(256, 11)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 10
for _k, _chars in ((3, b" \t"), (4, b"\n\r"), (5, b",."), (6, b"()[]{}'\"`"), (7, b"!?:;-_/"), (8, b"#$%&*+<=>@\\^~"), (9, b"|")):
    for _c in _chars:
        _CLASS[_c] = _k
N_FEATURES = _CLASSES * _CLASSES + 5


def passage_features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of a slice of texts, and for each text the index of its first passage (n + 1)."""
    starts, ends, first = K.words(data, offs, K.SPACES)
    hashes = K.word_hashes(data, starts, ends)
    n_words = np.diff(first)
    n_passages = np.maximum(1, -(-n_words // PASSAGE_WORDS))
    bag = np.concatenate([[0], np.cumsum(n_passages)])
    text = K.text_of(first)
    passage = bag[:-1][text] + (np.arange(len(starts)) - first[:-1][text]) // PASSAGE_WORDS
    count = int(bag[-1])
    # bytes go to the passage of the last word that began before them
    of_byte = np.repeat(bag[:-1], np.diff(offs))
    if len(starts):
        mark = np.zeros(len(data), np.int64)
        fresh = np.flatnonzero(np.diff(passage, prepend=-1) * (np.diff(text, prepend=-1) == 0))
        mark[starts[fresh]] = 1
        run = np.cumsum(mark)
        base = np.repeat(run[np.minimum(offs[:-1], len(data) - 1)] - mark[np.minimum(offs[:-1], len(data) - 1)], np.diff(offs)) if len(data) else run
        of_byte = of_byte + run - base
    kind = _CLASS[data]
    pair = kind[:-1] * _CLASSES + kind[1:]
    same = of_byte[:-1] == of_byte[1:]
    table = np.bincount(of_byte[:-1][same] * (_CLASSES * _CLASSES) + pair[same], minlength=count * _CLASSES * _CLASSES).reshape(count, -1) if len(data) > 1 else np.zeros((count, _CLASSES * _CLASSES))
    out = np.zeros((count, N_FEATURES), np.float32)
    total = np.maximum(table.sum(axis=1, keepdims=True), 1)
    out[:, : _CLASSES * _CLASSES] = np.sqrt(table / total)
    words = np.bincount(passage, minlength=count)
    some = np.maximum(words, 1)

    def share_repeated(n: int) -> np.ndarray:
        """Share of a passage's words that begin a run of n words that its text has more than once."""
        runs, inside = K.grams(hashes, n), K.whole(first, n)
        if not inside.any():
            return np.zeros(count)
        at = np.flatnonzero(inside)
        key = K.mix(runs[at] + text[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        ordered = key[order]
        twice = np.zeros(len(key), bool)
        equal = ordered[1:] == ordered[:-1]
        twice[order[1:][equal]] = True
        twice[order[:-1][equal]] = True
        return np.bincount(passage[at[twice]], minlength=count) / some

    k = _CLASSES * _CLASSES
    out[:, k], out[:, k + 1] = share_repeated(3), share_repeated(1)
    out[:, k + 2] = np.bincount(passage, weights=ends - starts, minlength=count) / some / 10
    out[:, k + 3] = words / PASSAGE_WORDS
    out[:, k + 4] = np.repeat(np.log1p(n_words) / 10, n_passages)
    return out, bag


class AttentionModel:
    """Encoder, gated attention and classifier in numpy. prior: the score where nothing could be learned."""

    def __init__(self, features: int = N_FEATURES, seed: int = 0):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.w = {"e": draw(features, UNITS), "eb": np.zeros(UNITS, np.float32), "v": draw(UNITS, ATTENTION), "u": draw(UNITS, ATTENTION), "a": draw(ATTENTION, 1), "c": draw(UNITS, 1), "cb": np.zeros(1, np.float32)}
        self.mean, self.scale = np.zeros(features, np.float32), np.ones(features, np.float32)
        self.prior: float | None = None

    def _forward(self, x: np.ndarray, bag: np.ndarray):
        """x: passages by features; bag: the first passage of each text (n + 1)."""
        w = self.w
        h = np.tanh(((x - self.mean) * self.scale) @ w["e"] + w["eb"])
        t, s = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-(h @ w["u"])))
        g = t * s
        e = (g @ w["a"])[:, 0]
        sizes = np.diff(bag)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, bag[:-1]), sizes))
        a = e / np.repeat(np.add.reduceat(e, bag[:-1]), sizes)
        z = np.add.reduceat(a[:, None] * h, bag[:-1], axis=0)
        y = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["cb"], -30, 30)[:, 0]))
        return h, t, s, g, a, z, y

    def scores(self, x: np.ndarray, bag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score of each text, and attention weight of each passage."""
        *_, a, _, y = self._forward(x, bag)
        return (np.full(len(y), self.prior) if self.prior is not None else y), a

    def gradients(self, x: np.ndarray, bag: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        w = self.w
        h, t, s, g, a, z, y = self._forward(x, bag)
        sizes = np.diff(bag)
        total = weight.sum()
        loss = float(-(weight * (label * np.log(y + 1e-9) + (1 - label) * np.log(1 - y + 1e-9))).sum() / total)
        dy = (weight * (y - label) / total)[:, None]
        dz = np.repeat(dy @ w["c"].T, sizes, axis=0)
        dh = a[:, None] * dz
        da = (h * dz).sum(axis=1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, bag[:-1]), sizes))
        dg = de[:, None] @ w["a"].T
        dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
        dh += dt @ w["v"].T + ds @ w["u"].T
        dp = dh * (1 - h * h)
        n = (x - self.mean) * self.scale
        return loss, {"e": n.T @ dp, "eb": dp.sum(axis=0), "v": h.T @ dt, "u": h.T @ ds, "a": g.T @ de[:, None], "c": z.T @ dy, "cb": dy.sum(axis=0)}

    def train(self, bags: list[np.ndarray], label: np.ndarray, weight: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = 0.02, decay: float = 1e-4, seed: int = 1) -> list[float]:
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(axis=0), np.minimum(1 / (every.std(axis=0) + 1e-3), 50).astype(np.float32)
        rng = np.random.default_rng(seed)
        m, s = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        losses = []
        for step in range(1, steps + 1):
            at = rng.integers(0, len(bags), batch)
            bag = np.concatenate([[0], np.cumsum([len(bags[i]) for i in at])])
            loss, g = self.gradients(np.concatenate([bags[i] for i in at]), bag, label[at], weight[at])
            losses.append(loss)
            now = rate * (1 - (step - 1) / steps)
            for k, x in g.items():
                x = x + decay * self.w[k]
                m[k] += 0.1 * (x - m[k])
                s[k] += 0.01 * (x * x - s[k])
                self.w[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return losses


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_docs: int = SAMPLE_DOCS, steps: int = STEPS, sample_bytes: int = SAMPLE_BYTES) -> AttentionModel:
    """Learns from the labels given; each class's ids are sampled by their hash, so that the sample is the same every time. Of the
    sampled documents, those are taken in the order of their texts' hashes that fit into sample_bytes."""
    rows = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    picked = None
    for k in (0, 1):
        part = rows.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
        picked = part if picked is None else picked.unionAll(part)
    ids = picked.groupBy("doc_id").agg(F.avg("label").alias("label"), F.count("*").cast("double").alias("weight"))  # at most 2 * sample_docs rows

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = []
            for _, _, data, offs in K.slices(batch.column("text")):
                x, bag = passage_features(data, offs)
                bags += [x[a:b].tobytes() for a, b in zip(bag[:-1], bag[1:], strict=True)]
            if bags:
                yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("weight"), pa.array(bags, pa.binary())], ["label", "weight", "bag"])

    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = docs.join(F.broadcast(ids), "doc_id").select("doc_id", "label", "weight", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("key"))
    sizes = known.groupBy("doc_id", "key").agg(F.max(F.octet_length("text")).alias("size")).orderBy("key", "doc_id").limit(4 * sample_docs).collect()
    chosen, left = [], sample_bytes
    for r in sizes:
        if r["size"] <= left:
            left -= r["size"]
            chosen.append((r["doc_id"], r["key"]))
    keys = F.broadcast(documents.sparkSession.createDataFrame(chosen, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key long"))
    sample = known.join(keys, ["doc_id", "key"]).groupBy("doc_id", "key").agg(F.first("label").alias("label"), F.first("weight").alias("weight"), F.min("text").alias("text"))
    found = sample.select("label", "weight", "text").mapInArrow(describe, "label double, weight double, bag binary").collect()
    found.sort(key=lambda r: (r["bag"], r["label"]))
    model = AttentionModel()
    if not found or len(counts) < 2:
        model.prior = float(counts.get(1, 0) / sum(counts.values())) if counts else 0.5
        return model
    bags = [np.frombuffer(r["bag"], np.float32).reshape(-1, N_FEATURES) for r in found]
    label, weight = (np.array([r[c] for r in found], np.float32) for c in ("label", "weight"))
    share = counts[1] / (counts[0] + counts[1])
    own = float((label * weight).sum() / weight.sum())
    if 0 < own < 1:
        weight = weight * (label * share / own + (1 - label) * (1 - share) / (1 - own)).astype(np.float32)
    model.train(bags, label, weight, steps)
    return model


def score(documents: DataFrame, model: AttentionModel, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document row: its id, extra columns, score, predicted."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    extra = extra or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            for i, j, data, offs in K.slices(texts):
                part = batch.slice(i, j - i)
                y, _ = shared.value.scores(*passage_features(data, offs))
                y = np.clip(np.round(y.astype(np.float64), 6), 0, 1)
                names = [name for name in batch.schema.names if name != "text"]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(n)) for n in names), pa.array(y), pa.array((y >= threshold).astype(np.int32))], [*names, "score", "predicted"])

    docs = documents.select(F.col(id_col).alias("doc_id"), *(c.alias(k) for k, c in extra.items()), F.col(text_col).cast("string").alias("text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(run, f"{kinds}, score double, predicted int")

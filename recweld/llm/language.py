"""Language identification by a bidirectional gated recurrent network over bytes.

Training sees a bounded sample of the labelled rows (SAMPLE_DOCS documents and SAMPLE_BYTES, balanced over languages; the
bounds are parameters and do not depend on the input) and all windows of LENGTH bytes of their whole texts. Each document weighs the
same, whatever its length. Prediction cuts every whole text into windows of LENGTH bytes, labels each byte, and a document's
probabilities are the means over all its bytes. A text without a letter is UNKNOWN with score 0.

Null and empty texts are UNKNOWN. Without any labelled training text, every document is. Equal texts get equal results;
texts that repeat count once in the sample. Labels are used as they are; of more than MAX_LANGS, the most frequent are
learned (the smaller label first among equals) and rows of others are not trained on. An empty table gives an empty result;
columns other than the id, text and label are carried along or ignored, whatever they are called. Memory in a task is bounded
by a block of windows or by the longest text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K
from .common import fresh_name
from .gru import PAD, ByteGru

UNKNOWN = "und"
LENGTH, HIDDEN = 64, 10
SAMPLE_DOCS, SAMPLE_BYTES = 1600, 24 << 20
STEPS, BATCH = 400, 128
MAX_LANGS = 256
#: A document is rejected if its best language has a score of less than LEAST times that of chance, 1 / (number of
#: languages, 2 at least). From a score of SURE on, a prediction replaces a label.
LEAST, SURE = 1.2, 0.9
_BLOCK = 1024
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


class Model:
    def __init__(self, langs: list[str], net: ByteGru | None):
        self.langs, self.net = langs, net


def sample(documents: DataFrame, text_col: str, lang_col: str, docs: int = SAMPLE_DOCS, most: int = SAMPLE_BYTES) -> tuple[list[str], list[tuple[str, bytes]]]:
    """Languages, and a balanced sample of (language, whole text): the first of each language in the order of their hashes,
    each text once, up to its share of ``docs`` texts and ``most`` bytes. Texts that do not fit into that are passed over."""
    rows = documents.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null and text <> ''")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()}
    if not counts:
        return [], []
    each, room = max(1, docs // len(counts)), most // len(counts)
    keyed = rows.where(F.col("lang").isin(*counts)).select("lang", "text", F.xxhash64("text").alias("key"), F.octet_length("text").alias("size")).where(F.col("size") <= room)
    rate = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 8.0 * each / n)))])
    found = _smallest(keyed.where(F.pmod("key", F.lit(1_000_000)) < F.element_at(rate, F.col("lang")) * 1_000_000), each)
    own = Counter(r["lang"] for r in found)
    if any(own[k] < min(each, n) for k, n in counts.items()):  # many rows repeat few texts: all are looked at
        found = _smallest(keyed, each)
    left, chosen = dict.fromkeys(counts, room), []
    for r in sorted(found, key=lambda r: (r["lang"], r["key"])):
        if r["size"] <= left[r["lang"]]:
            left[r["lang"]] -= r["size"]
            chosen.append((r["lang"], r["key"]))
    if not chosen:
        return sorted(counts), []
    keys = F.broadcast(documents.sparkSession.createDataFrame(chosen, "lang string, key long"))
    texts = keyed.join(keys, ["lang", "key"]).groupBy("lang", "key").agg(F.min("text").alias("text")).collect()
    return sorted(counts), sorted((r["lang"], r["text"].encode()) for r in texts)


def _smallest(keyed: DataFrame, each: int) -> list:
    """The smallest distinct keys of each language, at most ``each``, with the sizes of their texts."""
    place = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    return keyed.groupBy("lang", "key").agg(F.max("size").alias("size")).withColumn("place", place).where(F.col("place") <= each).collect()


def train(documents: DataFrame, text_col: str = "text", lang_col: str = "lang", steps: int = STEPS, docs: int = SAMPLE_DOCS) -> Model:
    """Learns from a sample of the rows with a text and a label."""
    langs, rows = sample(documents, text_col, lang_col, docs)
    if not rows:
        return Model(langs, None)
    windows, labels, share = windows_of(langs, rows)
    net = ByteGru(HIDDEN, len(langs))
    net.train(windows, labels, (windows != PAD).astype(np.float32), steps, BATCH, share=share)
    return Model(langs, net)


def windows_of(langs: list[str], rows: list[tuple[str, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts (LENGTH x count), their labels, and the share of draws of each: equal for all languages, and
    for all texts of one. Some windows are cut short, as short texts are to be told as well."""
    index = {k: i for i, k in enumerate(langs)}
    parts, labels, share = [], [], []
    per_lang = np.bincount([index[lang] for lang, _ in rows], minlength=len(langs))
    for i, (lang, text) in enumerate(rows):
        count = -(-len(text) // LENGTH)
        own = np.frombuffer(text.ljust(count * LENGTH, bytes([PAD])), np.uint8).reshape(count, LENGTH).copy()
        for k in range(i % 7, count, 7):
            own[k, 8 + (i + k) % 24 :] = PAD
        parts.append(own)
        labels.append(np.full(count, index[lang]))
        share.append(np.full(count, 1.0 / (count * per_lang[index[lang]])))
    share = np.concatenate(share)
    return np.concatenate(parts).T.copy(), np.concatenate(labels), share / share.sum()


def _letters(data: np.ndarray, offs: np.ndarray, array: pa.Array) -> np.ndarray:
    """Whether each text has a letter."""
    seen = np.concatenate([[0], np.cumsum(_LETTER[data])])
    out = seen[offs[1:]] > seen[offs[:-1]]
    for i in np.flatnonzero(~out & (offs[1:] > offs[:-1])):
        out[i] = any(c.isalpha() for c in array[int(i)].as_py())
    return out


def pooled(net: ByteGru, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Mean probabilities over the bytes of each text; zeros for empty texts."""
    sizes = np.diff(offs)
    counts = -(-sizes // LENGTH)
    first = np.concatenate([[0], np.cumsum(counts)])
    text = np.repeat(np.arange(len(sizes)), counts)
    start = offs[:-1][text] + (np.arange(first[-1]) - first[:-1][text]) * LENGTH
    left = np.minimum(LENGTH, offs[1:][text] - start)
    sums = np.zeros((first[-1], net.classes), np.float64)
    step = np.arange(LENGTH)[:, None]
    for i in range(0, len(start), _BLOCK):
        a, n = start[i : i + _BLOCK], left[i : i + _BLOCK]
        inside = step < n[None, :]
        at = np.minimum(a[None, :] + step, len(data) - 1)
        windows = np.where(inside, data[at], PAD)
        p = net.probabilities(windows)
        if not inside.all():
            p *= inside[:, :, None]
        sums[i : i + _BLOCK] = p.sum(axis=0, dtype=np.float64)
    out = np.zeros((len(sizes), net.classes))
    some = np.flatnonzero(sizes)
    if len(some):
        out[some] = np.add.reduceat(sums, first[:-1][some], axis=0) / sizes[some][:, None]
    return out


def predict(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per document row: its id, extra columns, lang_pred, score."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    extra = extra or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            for i, j, data, offs in K.slices(texts):
                part = batch.slice(i, j - i)
                if known.net is None:
                    best, score = [UNKNOWN] * (j - i), np.zeros(j - i)
                else:
                    p = pooled(known.net, data, offs)
                    letters = _letters(data, offs, texts.slice(i, j - i))
                    top = p.argmax(axis=1)
                    score = np.where(letters, np.clip(np.round(p[np.arange(j - i), top], 6), 0, 1), 0.0)
                    best = [known.langs[t] if ok else UNKNOWN for t, ok in zip(top.tolist(), letters.tolist(), strict=True)]
                columns = [part.column(k) for k, name in enumerate(batch.schema.names) if name != "text"]
                names = [name for name in batch.schema.names if name != "text"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(best, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    docs = documents.select(F.col(id_col).alias("doc_id"), *(c.alias(k) for k, c in extra.items()), F.col(text_col).cast("string").alias("text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def keep_known(documents: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang", least: float = LEAST) -> DataFrame:
    """The documents of a known language, all columns as they are but for lang_col, which is the predicted language.

    Texts without a letter, null and empty ones go, and those whose best language is hardly more likely than by chance
    (see LEAST). A document that has a label keeps it where the prediction is not sure (a score below SURE). Without anything learned, no text can
    be rejected: all documents with a letter stay, labels as they are.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    last = len(documents.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            at = batch.schema.get_field_index(lang_col)
            field = batch.schema.field(at)
            for i, j, data, offs in K.slices(batch.column(last)):
                part = batch.slice(i, j - i)
                keep = _letters(data, offs, part.column(last))
                own = pa.RecordBatch.from_arrays(part.columns[:last], documents_names)
                if known.net is not None:
                    p = pooled(known.net, data, offs)
                    top = p.argmax(axis=1)
                    score = p[np.arange(j - i), top]
                    keep &= score >= least / max(2, len(known.langs))
                    langs = [known.langs[t] if x is None or s >= SURE else x for x, t, s in zip(part.column(at).to_pylist(), top.tolist(), score.tolist(), strict=True)]
                    own = own.set_column(at, field, pa.array(langs, field.type))
                yield own.filter(pa.array(keep))

    documents_names = documents.columns
    texts = documents.select("*", F.col(text_col).cast("string").alias(fresh_name("_text", documents.columns)))
    return texts.mapInArrow(run, documents.schema)

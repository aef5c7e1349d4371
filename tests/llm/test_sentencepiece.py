import random
import struct
import time

import numpy as np
import pyarrow as pa
import pytest

from recweld.llm import kernel as K
from recweld.llm import sentencepiece as S

RAW = open(S.MODEL_PATH, "rb").read()


def unigram():
    """A unigram model over the same pieces, with random scores (as equal sums would be a matter of taste)."""
    rng, out = random.Random(9), []
    for number, value in S._fields(RAW):
        if number == 1:
            own = dict(S._fields(value))
            body = b"\x0a" + bytes([len(own[1])]) + own[1] + b"\x15" + struct.pack("<f", rng.uniform(-14, -6)) + (bytes([0x18, own[3]]) if 3 in own else b"")
            out.append(b"\x0a" + bytes([len(body)]) + body)
    tail = RAW[RAW.rindex(b"\x12\xe8\x01") :]
    return b"".join(out) + tail + b"\x12\x02\x18\x01"


AS_UNIGRAM = unigram()


def library(raw):
    sp = pytest.importorskip("sentencepiece")
    return sp.SentencePieceProcessor(model_proto=raw)


def texts(spaces=True, odd=True):
    rng = random.Random(4)
    words = ["the", "unbelievable", "Straße", "déjà", "internationalization", "x", "12345", "e.g.", "foo_bar", "ing", "tion"] + (["日本語", "\U0001f600", "\n", "\t", "ﬁ", "\x00"] if odd else [])
    out = ["", "a", "the " * 50]
    for _ in range(400):
        out.append("".join(rng.choice(words) + " " * rng.choice([0, 1, 1, 1, 2, 3, 9] if spaces else [0, 1]) for _ in range(rng.randint(1, 40))))
        out.append("".join(rng.choice("abcdeinorst" + (" é" if spaces else "")) for _ in range(rng.randint(1, 40))))
    return out + ["z" * 3000, "ab" * 700] + ([" ", "   ", " " * 77] if spaces else [])


def unspaced():
    rng = random.Random(6)
    base = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    words = ["the", "unbelievable", "international", "x", "12345", "ing", "日本", "é", "e", "t", "_", "\U0001f600"]
    out = ["".join(rng.choice(base) for _ in range(n)) for n in (1500, 1521, 9000)] + ["".join(rng.choice("abcdefghij") for _ in range(7000))]
    out += ["".join(rng.choice(words) for _ in range(4000)), "日本語の文章" * 900, "z" * 5000, "ab" * 4000, "abc" * 3333, "the" * 2222, "ing" * 2001 + "x" + "ing" * 1500, "=" * 4001, "-" * 3001 + "a" * 3001]
    return out + ["a " * 30 + "q" * 4000 + "  b", "\n" * 3000, " " * 3001, "a" + " " * 4000 + "b", " " * 2999 + "the"] + [" " * k + w for k in range(1, 70) for w in ("", "the", "x", "日")]


def test_unspaced_texts_equal_the_library():
    batch = unspaced()
    got, back = encoded(S.Model(RAW), batch)
    want = library(RAW).encode(batch)
    assert [i for i in range(len(batch)) if got[i] != want[i]] == [] and back == batch


def test_chunks_that_never_agree(monkeypatch):
    """They are searched on from where the word is known."""
    batch = unspaced()
    want = encoded(S.Model(RAW), batch)[0]
    monkeypatch.setattr(S.Model, "_agree", lambda *a: -1)
    assert encoded(S.Model(RAW), batch[:6])[0] == want[:6]


def test_long_unigram_words():
    model = S.Model(AS_UNIGRAM)
    for text in unspaced()[:5]:
        points = np.array([ord("▁"), *map(ord, text)], np.uint32)
        best, _, _ = model._search(points[None])
        ids = model._long(points)
        assert np.isclose(model.weights[ids].sum(), best[0, -1]) and model.lengths[ids].sum() == len(points)


def test_time_on_unspaced_text():
    model = S.Model(RAW)
    rng = random.Random(2)
    text = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(1 << 20))
    t = time.process_time()
    assert encoded(model, [text])[1] == [text]
    assert time.process_time() - t < 40


def encoded(model, batch):
    data, offs = K.utf8_buffer(pa.array(batch, pa.string()))
    ids, at = model.encode(data, offs)
    back, back_offs = model.decode(ids, at)
    decoded = [back[a:b].tobytes().decode() for a, b in zip(back_offs[:-1], back_offs[1:], strict=True)]
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)], decoded


def test_merges_equal_the_library():
    batch = texts()
    got, back = encoded(S.Model(RAW), batch)
    assert got == library(RAW).encode(batch) and back == batch


def test_unigram_equals_the_library():
    batch = [t for t in texts(False, False)]
    model = S.Model(AS_UNIGRAM)
    assert model.kind == 1
    got, back = encoded(model, batch)
    want = library(AS_UNIGRAM).encode(batch)
    differ = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    assert back == batch and len(differ) < len(batch) / 10
    assert all(sorted(a) == sorted(b) for a, b in differ)  # the same pieces in another order have the same sum


def test_forgetting_changes_nothing(monkeypatch):
    batch = texts()
    want = encoded(S.Model(RAW), batch)[0]
    monkeypatch.setattr(S, "WORD_MEMO", 50)
    monkeypatch.setattr(S, "PAIR_MEMO", 50)
    model = S.Model(RAW)
    assert [x for i in range(0, len(batch), 7) for x in encoded(model, batch[i : i + 7])[0]] == want


def test_rows(spark):
    batch = [None, "", "Grüße an\nalle  hier", "a▁b", "x", "x"]
    df = spark.createDataFrame(list(enumerate(batch)), "doc_id long, text string").selectExpr("*", "'i' as ids", "1 as n_pieces").repartition(2)
    enc = S.encode(df)
    rows = {r["doc_id"]: r for r in enc.collect()}
    assert rows[0]["ids"] == rows[1]["ids"] == [] and rows[4]["ids"] == rows[5]["ids"]
    assert [rows[i]["round_trip"] for i in range(6)] == [True, True, True, False, True, True]
    lib = library(RAW)
    assert all(rows[i]["ids"] == lib.encode(batch[i] or "") and rows[i]["n_pieces"] == len(rows[i]["ids"]) for i in range(6))
    back = {r["doc_id"]: r["text"] for r in S.decode(enc).collect()}
    assert [back[i] for i in range(6)] == ["", "", "Grüße an\nalle  hier", "a b", "x", "x"]
    assert S.encode(df.limit(0)).count() == 0 and S.encode(df.selectExpr("*", "'l' as lang"), carry=("lang",)).columns == ["doc_id", "lang", "n_pieces", "ids", "round_trip"]
    assert np.array_equal(S.Model(RAW).byte_ids, np.arange(3, 259))

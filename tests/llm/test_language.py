import zlib

import numpy as np

from recweld.llm import language as L
from recweld.llm.gru import ByteGru
from recweld.llm.queries import op2_language_id

SF = "/root/testdata/sf0.01"


def test_gradients():
    rng = np.random.default_rng(1)
    net = ByteGru(3, 2, seed=4)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    windows, labels = rng.integers(0, 5, (6, 4)).astype(np.uint8), np.array([0, 1, 1, 0])
    weight = (rng.random((6, 4)) > 0.2).astype(float)
    # states are kept as float32: steps are large and the bound is loose
    _, g = net.gradients(windows, labels, weight)
    for k, v in net.w.items():
        for at in list(np.ndindex(v.shape))[:: max(1, v.size // 25)]:
            old, eps = v[at], 2e-3
            v[at] = old + eps
            up = net.gradients(windows, labels, weight)[0]
            v[at] = old - eps
            down = net.gradients(windows, labels, weight)[0]
            v[at] = old
            assert abs((up - down) / (2 * eps) - g[k][at]) < 2e-3, (k, at)


def test_held_out_accuracy(spark):
    got = op2_language_id(spark, SF).collect()
    truth = {r["doc_id"]: (r["lang"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(got) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)
    own = [r["lang_pred"] == truth[r["doc_id"]][0] for r in got if r["held_out"] and len(truth[r["doc_id"]][1]) >= 40]
    assert np.mean(own) > 0.97
    by_text = {}
    for r in got:
        text = truth[r["doc_id"]][1]
        assert by_text.setdefault(text, (r["lang_pred"], r["score"])) == (r["lang_pred"], r["score"])


def test_rows(spark):
    en, fr = "the thing with that other house was over there " * 4, "être déjà allé où ça a été créé à l'école là-bas " * 4
    rows = [(i, en if i % 2 else fr, "en" if i % 2 else "fr") for i in range(40)] + [(50, None, "en"), (51, "", "fr"), (52, "123 !? 456", "en"), (53, "the other house", None), (54, "ñ", None), (None, en, None), (55, en * 900, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "'x' as lang_pred").repartition(3)
    model = L.train(df.where("doc_id < 40 or doc_id = 50"), steps=60)
    got = {r["doc_id"]: r for r in L.predict(df, model).collect()}
    assert [got[i]["lang_pred"] for i in (50, 51, 52)] == ["und"] * 3 and got[52]["score"] == 0
    assert got[54]["lang_pred"] in ("en", "fr") and got[None]["lang_pred"] == got[55]["lang_pred"] == "en"
    assert all(got[i]["lang_pred"] == ("en" if i % 2 else "fr") for i in range(40))
    nothing = L.train(df.where("lang is null"))
    assert {r["lang_pred"] for r in L.predict(df, nothing).collect()} == {"und"}
    assert L.predict(df.limit(0), model).count() == 0


def loops(net, window):
    """The network's probabilities at every position of one window, in plain loops."""
    from math import exp, tanh

    n, w = net.hidden, {k: v.tolist() for k, v in net.w.items()}
    states = []
    for d in (0, 1):
        h, own = [0.0] * n, []
        for byte in window if d == 0 else window[::-1]:
            x = w["x"][d][byte]
            a = [sum(h[i] * w["u"][d][i][j] for i in range(n)) for j in range(3 * n)]
            gate = [1 / (1 + exp(-(a[j] + x[j]))) for j in range(2 * n)]
            s = [tanh(x[2 * n + j] + gate[j] * (a[2 * n + j] + w["c"][d][0][j])) for j in range(n)]
            h = [gate[n + j] * h[j] + (1 - gate[n + j]) * s[j] for j in range(n)]
            own.append(h)
        states.append(own if d == 0 else own[::-1])
    out = []
    for f, b in zip(*states, strict=True):
        logits = [sum(v * w["v"][i][k] for i, v in enumerate(f + b)) + w["b"][k] for k in range(net.classes)]
        top = [exp(x - max(logits)) for x in logits]
        out.append([x / sum(top) for x in top])
    return out


def test_pooled_probabilities_equal_plain_loops():
    import pyarrow as pa

    from recweld.llm import kernel as K

    net = ByteGru(4, 3, seed=5)
    texts = ["", "a", "Some words of a short text, é.", "x" * 64, "a text that is longer than one window is, and so goes on for quite a while " * 2]
    got = L.pooled(net, *K.utf8_buffer(pa.array(texts)))
    for text, p in zip(texts, got, strict=True):
        raw = list(text.encode())
        windows = [raw[i : i + L.LENGTH] for i in range(0, len(raw), L.LENGTH)]
        every = [q for w in windows for q in loops(net, w + [0] * (L.LENGTH - len(w)))[: len(w)]]
        want = np.mean(every, axis=0) if every else np.zeros(3)
        assert np.allclose(p, want, atol=1e-5)


def test_training_sees_whole_texts_and_each_text_once(spark):
    rows = [(i, "one text that many rows repeat", "en") for i in range(3000)] + [(i + 5000, f"texte {i} " + "été " * 300 + "fin", "fr") for i in range(20)]
    langs, found = L.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), "text", "lang", docs=40)
    assert langs == ["en", "fr"] and sorted(x for x, _ in found) == ["en"] + ["fr"] * 20
    assert all(t.endswith(b"fin") for k, t in found if k == "fr")
    windows, labels, share = L.windows_of(langs, found)
    assert windows.shape == (L.LENGTH, sum(-(-len(t) // L.LENGTH) for _, t in found))
    assert np.allclose([share[labels == k].sum() for k in (0, 1)], 0.5)
    assert L.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "text", "lang", docs=40, most=500)[1] == [("en", b"one text that many rows repeat")]


def test_many_labels_and_none(spark, monkeypatch):
    monkeypatch.setattr(L, "MAX_LANGS", 3)
    rows = [(i, f"words of text {i} for one label", f"l{i % 5}") for i in range(50)] + [(99, "more for the first", "l0"), (98, "!!", "l0"), (97, None, "l1"), (96, "no label", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'t' as _text").repartition(2)
    model = L.train(df, steps=3)
    assert model.langs == ["l0", "l1", "l2"] and L.predict(df, model).count() == len(rows)
    unlabelled = df.withColumn("lang", L.F.lit(None).cast("string"))
    kept = L.keep_known(unlabelled, L.train(unlabelled))
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({r[0] for r in rows} - {97, 98})
    known = L.keep_known(df, model, least=0).collect()
    assert len(known) == len(rows) - 2 and all(r["lang"] for r in known)
    assert L.keep_known(df, model, least=10).count() == 0

import zlib

import numpy as np
import pyarrow as pa

from recweld.llm import kernel as K
from recweld.llm import quality as Q
from recweld.llm.queries import op5_quality

SF = "/root/testdata/sf0.01"


def test_gradients():
    rng = np.random.default_rng(2)
    model = Q.AttentionModel(6)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    x, bag = rng.standard_normal((9, 6)), np.array([0, 1, 4, 9])
    label, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    _, g = model.gradients(x, bag, label, weight)
    for k, v in model.w.items():
        for at in list(np.ndindex(v.shape))[:: max(1, v.size // 15)]:
            old, eps = v[at], 1e-5
            v[at] = old + eps
            up = model.gradients(x, bag, label, weight)[0]
            v[at] = old - eps
            down = model.gradients(x, bag, label, weight)[0]
            v[at] = old
            assert abs((up - down) / (2 * eps) - g[k][at]) < 1e-6, (k, at)


def test_passages_do_not_depend_on_neighbours():
    texts = ["a b " * 100, None, "", "One. two\n*** " * 30, "x", "A " * 48, " "]
    data, offs = K.utf8_buffer(pa.array(texts))
    every, bag = Q.passage_features(data, offs)
    assert np.diff(bag).tolist() == [5, 1, 1, 2, 1, 1, 1]
    for i, t in enumerate(texts):
        own, _ = Q.passage_features(*K.utf8_buffer(pa.array([t], pa.string())))
        assert np.allclose(own, every[bag[i] : bag[i + 1]])


def test_held_out(spark):
    got = {r["doc_id"]: r for r in op5_quality(spark, SF).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for i, r in got.items())
    own = [(r["score"], labels[i]) for i, r in got.items() if r["held_out"] and i in labels]
    good, bad = [s for s, y in own if y], [s for s, y in own if not y]
    assert np.mean([g > b for g in good for b in bad]) > 0.97


def test_rows(spark):
    rows = [(i, ("plain words that go on and on " * 9) if i % 2 else "### $$$ *** " * 20) for i in range(40)] + [(50, None), (51, ""), (None, "x"), (52, "w " * 9000), (50, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "1 as label", "2.0 as weight").repartition(3)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(1, 1, None), (2, None, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    got = Q.score(df, Q.train(df, labels, steps=80)).collect()
    assert len(got) == len(rows) and all(r["score"] == r["score"] for r in got)
    assert all((r["score"] > 0.7) == (r["doc_id"] % 2 == 1) for r in got if r["doc_id"] is not None and r["doc_id"] < 40)
    one = Q.score(df, Q.train(df, labels.where("quality = 1"))).collect()
    assert {r["score"] for r in one} == {1.0}
    assert {r["score"] for r in Q.score(df, Q.train(df, labels.limit(0))).collect()} == {0.5}
    assert Q.score(df.limit(0), Q.train(df, labels, steps=2)).count() == 0


def test_scores_equal_plain_loops():
    from math import exp, tanh

    rng = np.random.default_rng(3)
    model = Q.AttentionModel(5, seed=2)
    x, bag = rng.standard_normal((7, 5)).astype(np.float32), np.array([0, 1, 3, 7])
    got, weights = model.scores(x, bag)
    w = {k: v.tolist() for k, v in model.w.items()}
    dot = lambda row, m: [sum(a * m[i][j] for i, a in enumerate(row)) for j in range(len(m[0]))]
    for t, (a, b) in enumerate(zip(bag[:-1], bag[1:], strict=True)):
        h = [[tanh(v + c) for v, c in zip(dot(row, w["e"]), w["eb"], strict=True)] for row in x[a:b].tolist()]
        e = [sum(tanh(p) / (1 + exp(-q)) * c[0] for p, q, c in zip(dot(r, w["v"]), dot(r, w["u"]), w["a"], strict=True)) for r in h]
        share = [exp(v) / sum(map(exp, e)) for v in e]
        z = [sum(s * r[j] for s, r in zip(share, h, strict=True)) for j in range(len(h[0]))]
        y = 1 / (1 + exp(-(dot(z, w["c"])[0] + w["cb"][0])))
        assert abs(y - got[t]) < 1e-5 and np.allclose(share, weights[a:b], atol=1e-5)


def test_training_sees_all_passages_within_its_bound(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(Q.AttentionModel, "train", lambda self, bags, *a, **k: seen.append(sorted(len(b) for b in bags)))
    rows = [(1, "w " * 48 * 90), (2, "a b"), (2, "a b"), (3, "c " * 100), (4, None)]
    df, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, 0)], "doc_id long, quality int")
    Q.train(df, labels)
    Q.train(df, labels, sample_bytes=300)
    assert seen == [[1, 1, 3, 90], [1, 1, 3]]

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from recweld.llm import lm_score as L
from recweld.llm.common import crc_bucket
from recweld.llm.queries import op3_lm_scoring

SF = "/root/testdata/sf0.001"


def tokens(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall("[^\x20\x09-\x0d]+", lower), None]


def brute(rows):
    """Exact counts with the levels of the filter, without its errors."""
    one, two = Counter(), Counter()
    for _, text, held in rows:
        if not held:
            t = tokens(text)
            one.update(t)
            two.update(zip([None, *t], t))
    n, v = sum(one.values()), len(one)
    out = {}
    for i, text, held in rows:
        t = tokens(text)
        base = [(one[x] + 1) / (n + v + 1) for x in t]
        level = [2 ** int(math.log2(two[p])) if two[p] else 0 for p in zip([None, *t], t)]
        smooth = [(k + L.KAPPA * b) / (one[h] + L.KAPPA) for k, b, h in zip(level, base, [None, *t])]
        out[i] = (held, len(t), sum(one[x] > 0 for x in t), n, sum(map(math.log10, base)), sum(map(math.log10, smooth)))
    return out


def compare(got, want, errors):
    assert len(got) == len(want)
    off = []
    for r in got:
        w = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4]
        assert r["base_score"] == pytest.approx(w[4], abs=1e-7)
        if errors:
            off.append((r["score"] - w[5]) / w[1])
        else:
            assert r["score"] == pytest.approx(w[5], abs=1e-7)
    if errors:  # a filter never says less than it holds; what it says more is rare
        assert min(off) > -1e-6 and np.mean(off) < 0.05


def test_equals_brute_force(spark):
    got = op3_lm_scoring(spark, SF).collect()
    rows = [(r["doc_id"], r["text"], zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    compare(got, brute(rows), True)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_beyond_the_broadcast_bound(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("the a Cat dog sat on mat é".split()) for _ in range(rng.randint(0, 40)))) for i in range(300)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as bucket", "'k' as key", "2 as slice").repartition(3)
    held = crc_bucket("doc_id", 7) == 2
    want = brute([(i, t, zlib.crc32(str(i).encode()) % 7 == 2) for i, t in rows])
    compare(L.score(df, ~held, extra={"held_out": held}, broadcast_bytes=10).collect(), want, False)
    compare(L.score(df, ~held, extra={"held_out": held}, bucket_bytes=50).collect(), want, True)


def test_filter_levels():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 20000).astype(np.uint64)
    counts = np.random.default_rng(2).integers(1, 200, 20000)
    made = L.build_filter(keys[:10000], L.levels_of(counts[:10000]))
    held = L.Tables([{"bucket": 0, "n_buckets": 1, "words": b"", "counts": b"", "filter": made.tobytes()}], [(0, 0, len(made))])
    found = held.level(keys)
    assert (found[:10000] >= L.levels_of(counts[:10000])).all()
    assert (found[:10000] > L.levels_of(counts[:10000])).mean() < 0.03 and (found[10000:] > 0).mean() < 0.03


def test_no_training_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = L.score(df, F.lit(False)).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)]
    assert L.score(df.limit(0), F.lit(True)).count() == 0


def test_filter_at_every_size(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(30))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    held = crc_bucket("doc_id", 7) == 2
    one, other, broadcast = (sorted(map(tuple, L.score(df, ~held, **size).collect())) for size in ({}, {"broadcast_bytes": 10}, {"broadcast_bytes": 1 << 30}))
    assert one == other == broadcast
    exact = brute([(i, t, zlib.crc32(str(i).encode()) % 7 == 2) for i, t in rows])
    assert any(r[-1] > exact[r[0]][5] + 1e-6 for r in other)  # the filter's errors: it did run

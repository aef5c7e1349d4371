import random

from recweld.llm import token_counts as T


def test_histogram_answers_every_limit(spark):
    rng = random.Random(1)
    texts = [None, "", "<|endoftext|>", "a " * 3000] + ["wörd tokens 123 " * rng.randint(0, 90) + "x" * rng.randint(0, 9) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "7 as n_docs", "1 as n_tokens").repartition(3)
    encode = T._encoder(open(T.MODEL_PATH, "rb").read()).encode_ordinary
    lengths = [len(encode(t)) if t else 0 for t in texts]
    sums = T.token_counts(df).cache()
    rows = {r["n_tokens"]: r for r in sums.collect()}
    assert set(rows) == set(lengths)
    for n, r in rows.items():
        assert r["n_docs"] == lengths.count(n)
        assert r["docs_at_least"] == sum(x >= n for x in lengths)
        assert r["tokens_at_least"] == sum(x for x in lengths if x >= n)
        assert r["tokens_truncated"] == sum(min(x, n) for x in lengths)
        assert abs(r["share_at_most"] - sum(x <= n for x in lengths) / len(lengths)) < 1e-12
        assert (r["total_docs"], r["total_tokens"]) == (len(lengths), sum(lengths))
    limits = [0, 1, 5, 100, 101, 511, 1024, 4000, 10**6]
    for r in T.answer(sums, limits).collect():
        n = r["context_limit"]
        assert (r["docs_longer"], r["tokens_truncated"]) == (sum(x > n for x in lengths), sum(min(x, n) for x in lengths))
    for q in (0.1, 0.5, 0.9, 1.0):
        assert T.quantile(sums, q).first()[0] == sorted(lengths)[max(0, -(-int(q * 1000) * len(lengths) // 1000) - 1)]
    assert sorted(r["n_tokens"] for r in T.token_lengths(df).collect()) == sorted(lengths)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert T.token_counts(df).count() == 0
    assert T.answer(T.token_counts(df), [5]).first()["docs_longer"] == 0

import pytest

import corpus_pipeline as P
from recweld.llm import sentencepiece as S
from recweld.llm.pii import find_spans, redact_text

from .test_decontaminate import brute as contaminated
from .test_jaccard_join import brute as components

SF = "/root/testdata/sf0.001"


def test_equals_brute_force(spark):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=S.MODEL_PATH)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = {k: t for k, t in docs.items() if any(c.isalpha() for c in t or "")}
    docs = {k: docs[k] for k, _, c in components(list(docs.items())) if k == c}
    docs = {r[0]: docs[r[0]] for r in contaminated(list(docs.items()), items) if not r[5]}
    want = {k: sp.encode(redact_text(t, find_spans(t))) for k, t in docs.items()}
    got = P.run(spark, SF).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == want and len(got) == len(want) < 200
    assert all(r["round_trip"] for r in got)


def test_stages_on_odd_rows(spark, tmp_path):
    rows = [(1, None, None, "s", 0), (2, "", "en", None, 0), (3, "mail a@b.org now and then, as one does", None, "s", 38), (3, "mail a@b.org now and then, as one does", None, "s", 38), (4, "!!!", "en", "s", 3), (None, "Some plain words of a text that has no id", "en", "s", 41)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert sorted(map(tuple, docs.collect()), key=str) == [(3, "mail <EMAIL> now and then, as one does", "en", "s", 38), (None, "Some plain words of a text that has no id", "en", "s", 41)]
    assert P.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 2

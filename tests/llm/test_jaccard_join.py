import random
import re

import pytest

from recweld.llm import jaccard_join as J
from recweld.llm.components import components
from recweld.llm.queries import op1_jaccard_join

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    first = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            first[find(i)] = min(first.get(find(i), k), k)
    return sorted(((k, len(sets[i]), first.get(find(i))) for i, (k, _) in enumerate(rows)), key=str)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice("uvwxyz") * rng.randint(1, 3)
    return " ".join(words)


def cases():
    rng = random.Random(7)
    vocabulary = [a + b for a in "bcdfg" for b in "aeiou"]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts = [" ".join(say(rng.randint(0, 12))) for _ in range(120)] + [" ".join(rng.choice("ab") for _ in range(rng.randint(3, 12))) for _ in range(60)]
    for n in (20, 60, 200):
        base = say(n)
        texts += [edited(rng, base, rng.randint(0, max(1, n // 40))) for _ in range(25)]
    texts += [None, "", "one", "ONE", "one two", " ".join(say(3000))]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + [rows[0], (None, "ONE"), (None, "only here and nowhere else at all")]


@pytest.mark.parametrize("small,near,hot,bucket", [(64, 6, 20_000, 1 << 24), (3, 1, 20_000, 1 << 24), (4, 1, 5, 500)])
def test_equals_brute_force(spark, monkeypatch, small, near, hot, bucket):
    monkeypatch.setattr(J, "HOT", hot)
    monkeypatch.setattr(J, "DEAL", hot)
    monkeypatch.setattr(J, "PARTNERS", 3)
    rows = cases()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as class", "1 as n", "2 as component_id").repartition(3)
    monkeypatch.setattr(J, "SMALL", small)
    monkeypatch.setattr(J, "NEAR", near)
    got = J.jaccard_components(df, bucket_bytes=bucket).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows)


def test_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute(rows)
    assert sorted([tuple(r) for r in op1_jaccard_join(spark, SF).collect()], key=str) == want
    kept = J.deduplicate(spark.read.parquet(f"{SF}/documents.parquet"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(k for k, _, c in want if k == c)
    assert kept.columns == spark.read.parquet(f"{SF}/documents.parquet").columns


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(100, rng.randint(101, 160)) for _ in range(50)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(90)] + [(5, 5)]
    root = {x: x for e in links for x in e}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    del root[5], root[40]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {k: v for k, v in got.items() if k not in (5, 40)} == {k: v for k, v in root.items() if k in got} and got[40] == 0


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert J.jaccard_components(df).count() == 0
    assert J.deduplicate(df).count() == 0
    one = spark.createDataFrame([(1, None), (2, "  "), (3, "a b c d e f")], "doc_id long, text string")
    assert sorted(map(tuple, J.jaccard_components(one).collect())) == [(1, 0, 1), (2, 0, 2), (3, 2, 3)]


def test_many_rows_to_drop(spark, monkeypatch):
    """Beyond what is broadcast, rows are told apart by the bit table."""
    monkeypatch.setattr(J, "small_enough", lambda *a: False)
    docs = spark.createDataFrame([(i, f"some words that two rows have {i // 2}") for i in range(60)] + [(None, "some words that two rows have 3")], "doc_id long, text string")
    kept = J.deduplicate(docs).collect()
    assert sorted(r["doc_id"] for r in kept) == list(range(0, 60, 2))


@pytest.mark.parametrize("small", [True, False])
def test_rows_that_repeat_an_id(spark, monkeypatch, small):
    """Rows are told apart by id and class: only copies and repeats go, whatever ids they have."""
    monkeypatch.setattr(J, "small_enough", lambda *a: small)
    a, b, c = ("first text with quite some words here", "second one that has nothing to do with it", "third text which stands alone for itself")
    rows = [(5, a, 1), (5, b, 2), (6, a.upper(), 3), (6, c, 4), (7, b, 5), (8, None, 6), (8, "", 7), (8, None, 6), (9, "x y", 8), (9, "x y", 8), (9, "x  Y", 9), (None, a, 10), (None, "no id but words", 11), (None, "no id but words", 11), (None, "other row without", 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class int").selectExpr("*", "map('k', class) as m", "'z' as _class", "1 as stays").repartition(3)
    kept = J.deduplicate(docs)
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"], r["class"]) for r in kept.collect()), key=str)
    assert got == sorted([(5, a, 1), (5, b, 2), (6, c, 4), (8, None, 6), (8, "", 7), (8, None, 6), (9, "x  Y", 9), (None, "no id but words", 11), (None, "other row without", 12)], key=str)


def test_one_class_with_ten_thousand_partners(spark, monkeypatch):
    """Its pairs are dealt to many parts, and links stay whole."""
    spread = []
    pairs = spark.range(10_000).selectExpr("-1L as a", "id as b")
    grams = J.np.arange(8, dtype=J.np.uint64)
    sets = spark.range(-1, 10_000).select(J.F.col("id").alias("class"), J.F.lit(grams.tobytes()).alias("grams"))
    monkeypatch.setattr(J, "stored", lambda df, name: (spread.append(df.groupBy("part").count().collect()) if name == "pairs" else None) or df)
    spark.conf.set("spark.sql.shuffle.partitions", 64)
    try:
        assert J._verified(pairs, sets, 75).count() == 10_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    sizes = [r["count"] for r in spread[0]]
    assert sum(sizes) == 10_000 and max(sizes) <= 3 * J.PARTNERS and len(sizes) >= 7


@pytest.mark.parametrize("small,near", [(64, 6), (3, 1)])
def test_all_links_equal_brute_force(spark, monkeypatch, small, near):
    monkeypatch.setattr(J, "SMALL", small)
    monkeypatch.setattr(J, "NEAR", near)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = [(0, None)]
    for i in range(1, 41):  # near copies: one component, many links of each
        words = list(base)
        words[rng.randrange(56, 60)] = f"x{i}"
        rows.append((i, " ".join(words[: 60 - rng.randrange(4)])))
    rows += [(50, rows[1][1]), (51, "other words that no one else has here")]
    sets = {i: frozenset(zip(*(t.split()[k:] for k in range(J.NGRAM)))) for i, t in rows if t}
    distinct = set(sets.values())
    links = {a: sum(a != b and 100 * len(a & b) >= J.PERCENT * len(a | b) for b in distinct) for a in distinct}
    assert sum(links.values()) > 600
    got = J.jaccard_links(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["n_links"]) for r in got} == {i: (len(sets[i]), links[sets[i]]) if t else (0, 0) for i, t in rows}
    assert len({r["class"] for r in got if r["class"] is not None}) == len(distinct)

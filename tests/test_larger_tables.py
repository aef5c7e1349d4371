"""Cases that only larger tables bring about: ties, keys over the cap, large groups, nothing to learn from."""

import pytest
from pyspark.sql import functions as F

from recweld.functions import expressions as E
from recweld.operators import decisions as D
from recweld.operators import learning as L
from recweld.registry import oracle_sql, queries


def test_expected_f_takes_the_least_of_equal_prefixes(spark):
    # n candidates of 0.9, 11 n / 6 of 0.6: G is 0.75 with any number of the latter
    q = [(n, n - i, 0.9) for n in range(6, 66, 6) for i in range(n)] + [(n, 1000 - i, 0.6) for n in range(6, 66, 6) for i in range(11 * n // 6)]
    got = D.expected_f_rule(spark.createDataFrame(q, "s1 long, s23 long, q double")).groupBy("s1").count().collect()
    assert sorted(tuple(r) for r in got) == [(n, n) for n in range(6, 66, 6)]


def parts(spark, folder, rows):
    """A folder of the table part alone, as one file: (p_partkey, p_name, p_brand, p_type, p_size) rows."""
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").coalesce(1).write.parquet(f"{folder}/part.parquet")
    return str(folder)


def sql(folder, name):
    """The rows of the SQL, as sorted texts, which tell NaN and NULL apart."""
    con = pytest.importorskip("duckdb").connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{folder}/part.parquet/*.parquet'")
    found = con.execute(oracle_sql()[name])
    return [d[0] for d in found.description], sorted(map(str, found.fetchall()))


def equals_sql(spark, folder, name):
    columns, want = sql(folder, name)
    return sorted(str(tuple(r)) for r in queries()[name](spark, folder).select(columns).collect()) == want


def test_expected_f_decides_ties_as_the_sql_does(spark, tmp_path):
    # 60 brands, each a record with n candidates of 0.9 and 11 n / 6 of 0.6 (names of 10 letters, 1 and 4 of them changed)
    rows = []
    for b in range(60):
        n = (6, 12)[b % 5 % 2]
        names = [(0, "cdef")] + [(1, "cdex")] * n + [(1, "wxyz")] * (11 * n // 6)
        rows += [(3 * (100 * b + i) + src, "a b", f"Brand#{b}", kind, 1) for i, (src, kind) in enumerate(names)]
    folder = parts(spark, tmp_path, rows)
    assert queries()["expected_f_rule"](spark, folder).count() > 0 and equals_sql(spark, folder, "expected_f_rule")


@pytest.mark.parametrize("rows", [180, 2, 0])
def test_f05_macro_without_predictions(spark, tmp_path, rows):
    # all pairs share one key that is over the cap; only left-hand records; nothing at all
    folder = parts(spark, tmp_path, [(k * (3 if rows == 2 else 1), "hot ring", "Brand#1", "SMALL", k // 3) for k in range(rows)])
    assert equals_sql(spark, folder, "f05_macro")


def test_house_number_pairs_are_made_on_all_cores(spark, tmp_path):
    # a table of one small file, whose pairs are many
    folder = parts(spark, tmp_path, [(k, f"{'hot cold'.split()[k % 2]} ring", f"Brand#{k % 9}", "SMALL", k // 9) for k in range(900)])
    out = queries()["house_number_match"](spark, folder)
    assert out.select(F.spark_partition_id()).distinct().count() > 1
    assert equals_sql(spark, folder, "house_number_match")


def test_ordered_pairs_are_counted_as_they_would_be_joined(spark):
    # groups of 1 to 70 rows, keys repeated, out of order and NULL, groups of NULL
    r = [(g % 9 if g < 12 else None, k * 7919 % 53 if k % 11 else None, "abcdefgh"[(k * k + g) % 8]) for g in range(14) for k in range(g * g % 71 + 1)]
    t = spark.createDataFrame(r, "g int, k int, v string")
    want = {}
    for g, k, v in r:
        for h, m, w in r:
            if g is not None and g == h and k is not None and m is not None and k < m:
                want[v, w] = want.get((v, w), 0) + 1
    assert {(x["a"], x["b"]): x["n"] for x in L.ordered_pair_counts(t, ["g"], "k", "v").collect()} == want


def test_alias_mining_makes_no_pairs_of_records(spark, tmp_path, monkeypatch):
    # 1600 records of one brand and size and four names: some 1.3 million pairs, 16 kinds of pairs
    folder = parts(spark, tmp_path, [(k * 37 % 1601, ("hot ring", "cold ring", "hot bolt", "big old bolt")[k * k % 7 % 4], "Brand#1", "SMALL", 1) for k in range(1600)])
    made, mine = [], L.mine_aliases
    monkeypatch.setattr(L, "mine_aliases", lambda pairs, *a, **k: made.append(pairs.count()) or mine(pairs, *a, **k))
    assert equals_sql(spark, folder, "alias_mining") and made[0] <= 16


def test_counted_rows_are_learned_as_the_rows_they_count(spark):
    # 48 kinds of rows that count 1 to 188 times, the label no function of the feature
    kinds = spark.createDataFrame([(float(i % 16), float(i * i % 7 > i % 3), float(1 + 37 * i % 188)) for i in range(48)], "f double, y double, n double")
    rows = kinds.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("i", "n")
    settings = [{"rounds": 1, "depth": 2, "subsamplingRate": 1.0}, {"rounds": 3, "depth": 3, "subsamplingRate": 1.0}]
    counted, made = (dict(map(tuple, x.collect())) for x in (L.sweep(kinds, kinds, ["f"], settings, weight="n"), L.sweep(rows, rows, ["f"], settings)))
    assert counted == pytest.approx(made) and len(set(made.values())) == 2
    dealt = L.dealt(kinds, "n").groupBy("f", "y").agg(F.count("*").alias("k"), F.sum("n").alias("n")).join(kinds.groupBy("f", "y").agg(F.sum("n").alias("m")), ["f", "y"]).collect()
    assert all(r["n"] == pytest.approx(r["m"]) and r["k"] <= 3 * L.PARTS for r in dealt)


def test_hyper_parameters_count_pairs_by_their_features(spark, tmp_path, monkeypatch):
    # 7200 pairs of 60 left-hand and 120 right-hand records
    folder = parts(spark, tmp_path, [(k, "hot ring", "Brand#1", ("SMALL", "LARGE")[k // 3 % 2], k // 3) for k in range(180)])
    made, sweep = [], L.sweep
    monkeypatch.setattr(L, "sweep", lambda train, test, *a, **k: made.append(train.unionByName(test)) or sweep(train, test, *a, **k))
    assert queries()["hyper_parameters"](spark, folder).count() == 4
    assert made[0].count() < 100 and made[0].agg(F.sum("n")).first()[0] == 7200


def learned(monkeypatch):
    """(trees, rows) of every model that is fitted."""
    out, fitted = [], L.fitted
    monkeypatch.setattr(L, "fitted", lambda model, rows: out.append((fitted(model, rows), rows)) or out[-1][0])
    return out


def test_ablation_learns_all_rounds_from_all_records(spark, tmp_path, monkeypatch):
    folder = parts(spark, tmp_path, [(k, "hot ring", "Brand#1", ("SMALL", "LARGE")[k // 3 % 2], k // 3) for k in range(180)])
    held_out = {r["s1"] for r in queries()["gbt_scores"](spark, folder).select("s1").where(E.crc_split("s1")).distinct().collect()}
    models = learned(monkeypatch)
    assert queries()["ablation"](spark, folder).count() == 5 and 0 < len(held_out) < 60
    assert [(m.stages[-1].getNumTrees, m.stages[-1].getMaxDepth()) for m, _ in models] == [(40, 6)] * 5
    assert models[0][1].agg(F.sum("n")).first()[0] == pytest.approx(120 * (60 - len(held_out)))


@pytest.mark.parametrize("kinds", [("SMALL", "LARGE"), ("SMALL", "SMALL")])
def test_feature_importance_learns_all_rounds_from_all_pairs(spark, tmp_path, monkeypatch, kinds):
    # both classes, or true pairs only
    folder = parts(spark, tmp_path, [(k, "hot ring", "Brand#1", kinds[k // 3 % 2], k // 3) for k in range(180)])
    models = learned(monkeypatch)
    assert all(r["gain"] is not None for r in queries()["feature_importance"](spark, folder).collect())
    [(model, rows)] = models
    assert (model.stages[-1].getNumTrees, model.stages[-1].getMaxDepth(), model.stages[-1].getWeightCol()) == (40, 6, "n")
    # in the first case half of the pairs are true ones: balanced weights stay
    assert rows.agg(F.sum("n")).first()[0] == pytest.approx(7200)


MODELS = ["ablation", "gbt_scores", "oof_stack_scores", "feature_importance", "hyper_parameters"]


@pytest.mark.parametrize("name", MODELS)
def test_models_learn_where_all_keys_are_over_the_cap(spark, tmp_path, name):
    # 60 left-hand and 120 right-hand records, all of one key
    out = queries()[name](spark, parts(spark, tmp_path, [(k, "hot ring", "Brand#1", ("SMALL", "LARGE")[k // 3 % 2], k // 3) for k in range(180)])).collect()
    assert len(out) == {"ablation": 5, "feature_importance": 4, "hyper_parameters": 4}.get(name, 60 * 120) and all(r[-1] is not None for r in out)


@pytest.mark.parametrize("name", MODELS)
def test_models_without_anything_to_learn_from(spark, tmp_path, name):
    out = queries()[name](spark, parts(spark, tmp_path, [])).collect()
    assert len(out) == {"ablation": 5, "feature_importance": 4, "hyper_parameters": 4}.get(name, 0) and all(r[-1] is None for r in out)

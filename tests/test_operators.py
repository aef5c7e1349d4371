"""Small cases worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from recweld.functions import expressions as E
from recweld.operators import blocking as B
from recweld.operators import decisions as D
from recweld.operators import evaluation as V
from recweld.operators import features as X
from recweld.operators import learning as L
from recweld.operators import selection as S
from recweld.operators import validation as R
from recweld.plans import linkage
from recweld.sources import tables as T
from recweld.streaming.arrivals import write_arrivals


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_f05(spark):
    truth = spark.createDataFrame([("A", "x"), ("A", "y"), ("D", "w")], "s1 string, s23 string")
    pred = spark.createDataFrame([("A", "x"), ("C", "z")], "s1 string, s23 string")
    ids = spark.createDataFrame([(c,) for c in "ABCD"], "s1 string")
    e = V.per_entity(pred, truth, ids)
    assert {r["s1"]: round(r["f"], 6) for r in e.collect()} == {"A": 0.833333, "B": 1.0, "C": 0.0, "D": 0.0}
    m = V.summary(e).first()
    assert (round(m["f05"], 6), m["p_macro"], m["r_macro"], m["p_micro"], round(m["r_micro"], 6), m["singleton_acc"]) == (0.458333, 1.0, 0.25, 0.5, 0.333333, 0.5)
    claims = pred.withColumn("p", F.lit(0.5))
    assert {r["threshold"]: round(r["f05"], 6) for r in V.threshold_sweep(claims, truth, ids, [0.4, 0.6]).collect()} == {0.4: 0.458333, 0.6: 0.5}


def test_resolve(spark):
    p = spark.createDataFrame([("a", "x", 0.95), ("b", "x", 0.97), ("a", "y", 0.95), ("b", "y", 0.95), ("a", "z", 0.5)], "s1 string, s23 string, p double")
    assert rows(S.resolve(p, threshold=0.94).select("s1", "s23")) == [("a", "y"), ("b", "x")]
    assert V.contested(p, 0.94).first().asDict() == {"records": 2, "lost_claims": 2}


def test_margin(spark):
    p = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.9), (1, 3, 0.5), (2, 4, 0.9), (3, 5, 0.9), (3, 6, 0.5)], "g int, t int, x double")
    got = {r["t"]: round(r["margin"], 6) for r in S.with_rank_margin(p, "g", "x", "t").collect()}
    assert got == {1: 0.0, 2: 0.0, 3: -0.4, 4: 0.9, 5: 0.4, 6: -0.4}


def test_raw_score_and_house_numbers(spark):
    one = spark.createDataFrame([("407", "4071", "407 7", "4071")], "a string, b string, na string, nb string")
    h = one.select(*[c.alias(k) for k, c in X.house_numbers("a", "b", "na", "nb").items()]).first()
    assert (h["h_eq"], h["h_prefix"], h["h_contains"]) == (0.0, 1.0, 0.0) and h["h_logdiff"] == pytest.approx(math.log1p(3664))
    made = X.interactions(F.lit(1.0), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(True))
    r = one.select(made["raw_score"].alias("r"), made["ix_min_name_addr"].alias("m")).first()
    assert r["r"] == pytest.approx(0.775) and r["m"] is None


def test_expected_f(spark):
    q = spark.createDataFrame([("a", "x", 0.9), ("b", "y", 0.05), ("c", "z", 1.0)], "s1 string, s23 string, q double")
    assert rows(D.expected_f_rule(q)) == [("a", "x"), ("c", "z")]


def test_key_cap(spark):
    left = spark.createDataFrame([("a", "k"), ("b", "l")], "s1 string, key string")
    right = spark.createDataFrame([(f"x{i}", "k") for i in range(51)] + [(f"y{i}", "l") for i in range(50)], "s23 string, key string")
    assert B.shared_key_pairs(left, right).count() == 50


def test_anchor_excludes_itself(spark):
    p = spark.createDataFrame([("a", "x", 0.95), ("a", "y", 0.2), ("b", "z", 0.99)], "s1 string, s23 string, p1 double")
    names = spark.createDataFrame([(c, "n " + c, "n", "", "") for c in "xyz"], "id string, name string, skel string, addr string, hnum string")
    got = {r["s23"]: (r["anc_n"], r["anc_name"]) for r in L.anchor_features(p, L.anchors(p), names).collect()}
    assert got["x"] == (0, None) and got["z"] == (0, None) and got["y"][0] == 1 and got["y"][1] > 0


def test_region_map(spark):
    r = spark.createDataFrame([("u", "p", "r1")] * 3 + [("u", "q", "r1")] * 2 + [("u", "q", "r2")], "country string, loc string, region string")
    assert rows(L.region_map(r)) == [("u", "p", "r1", 3)]


def test_bins_and_guards(spark):
    d = spark.createDataFrame([(10.0, None), (9.0, 4.0), (None, 1.0)], "x double, y double")
    got = d.select(E.bin_of("x", [10.0]), E.bin_of("x", [10.0], True), E.strict_least("x", "y"), E.safe_divide(F.lit(1.0), F.lit(0.0)), E.clip("x", 9.5, 20)).collect()
    assert [tuple(r) for r in got] == [(0, 1, None, 0.0, 10.0), (0, 0, 4.0, 0.0, 9.5), (None, None, None, 0.0, None)]
    with pytest.raises(Exception, match="no value for"):
        d.select(E.lookup("x", {1.0: "a"})).collect()


def test_average_precision(spark):
    d = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.7, 0)], "s double, y int")
    assert V.average_precision(d, "s", "y").first()["ap"] == pytest.approx(0.5 * 1 + 0.5 * 0.5)


def test_bootstrap(spark):
    d = spark.createDataFrame([(0.1,)] * 90 + [(-0.1,)] * 5 + [(0.0,)] * 5, "d double")
    r = V.bootstrap_ci(d, "d", 400).first()
    assert r["lo"] < r["mean"] == pytest.approx(0.085) and r["hi"] > r["mean"] and (r["better"], r["worse"], r["unchanged"]) == (90, 5, 5)


def test_character_grams_and_weights(spark):
    d = spark.createDataFrame([(1, "ab c"), (2, "")], "id int, t string")
    assert [r[0] for r in d.select(B.char_grams(F.col("t"))).collect()] == [[" ab", "ab ", " c "], []]
    w = B.tfidf(spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (2, "y")], "id int, term string"))
    got = {(r["id"], r["term"]): r["w"] for r in w.collect()}
    x, y = (1 + math.log(2)) * (math.log(3 / 2) + 1), 1.0
    assert got[1, "x"] == pytest.approx(x / math.hypot(x, y)) and got[2, "y"] == 1.0
    v = {r["id"]: r["vector"] for r in B.projected_vectors(w, 256).collect()}
    dot = sum(a * b for a, b in zip(v[1], v[2], strict=True)) / math.sqrt(sum(a * a for a in v[1]) * sum(b * b for b in v[2]))
    assert dot == pytest.approx(got[1, "y"], abs=0.2)


def test_neighbours_in_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    a, b = rng.standard_normal((40, 6)), rng.standard_normal((60, 6))
    make = lambda m, k: spark.createDataFrame([(i % 2, k + i, [float(x) for x in r]) for i, r in enumerate(m)], "group int, id long, vector array<double>")
    small, whole = (rows(B.nearest_both_ways(make(a, 0), make(b, 100), 3, 2, block_rows=n)) for n in (7, 1000))
    assert small == whole and len(small) >= 120


def test_sources(spark, tmp_path):
    d = f"{tmp_path}/train"
    (tmp_path / "train").mkdir()
    head = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"
    (tmp_path / "train/train_source1.tsv").write_text(head + 'S1-1\tJoe"s "Shop"\t\tUS\nS1-2\tB\tx, y\tUS\n')
    (tmp_path / "train/train_source2.tsv").write_text(head + "S2-1\tJoes Shop\t\tUS\n")
    (tmp_path / "train/train_source3.tsv").write_text(head + "S3-1\tC\t1 Main St\tUS\n")
    (tmp_path / "train/train_ground_truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S3-1\nS1-2\t\n")
    s1, s23 = T.load_sources(spark, "train", str(tmp_path))
    assert rows(s1.select("business_name", F.col("business_address").isNull())) == [("B", False), ('Joe"s "Shop"', True)] and s23.count() == 2
    truth, ids = T.load_truth(spark, str(tmp_path))
    assert rows(truth) == [("S1-1", "S2-1"), ("S1-1", "S3-1")] and ids.count() == 2
    T.write_submission(ids, truth, truth, f"{d}/out")
    lines = sorted(r[0] for r in spark.read.text(f"{d}/out/matching_results.tsv").collect())
    assert set(lines) == {"S1-1\tS2-1,S3-1", "S1-2\t", "source1_entity_id\tmatched_entity_ids"}
    T.write_json({"a": 1}, f"{d}/x/t.json")
    assert T.read_json(f"{d}/x/t.json") == {"a": 1} and T.markdown(spark.range(1)) == "| id |\n| --- |\n| 0 |\n"
    T.write_parquet(truth, f"{d}/p")
    assert T.read_columns(spark, f"{d}/p", ["s1"]).columns == ["s1"]
    assert T.sample_rows(spark.range(100), 5, "id", 3).count() == 5
    with pytest.raises(ValueError):
        T.data_paths("dev")


def test_rules(spark, tmp_path):
    lists = spark.createDataFrame([("S1-1", "S2-1,S2-1"), ("S1-1", ""), ("S1-9", "S1-1,S2-7")], "source1_entity_id string, ids string")
    ids = spark.createDataFrame([("S1-1",), ("S1-2",)], "s1 string")
    right = spark.createDataFrame([("S2-1",), ("S2-2",)], "s23 string")
    got = {r["rule"]: r["n"] for r in R.list_rules(lists, ids, right, spark.createDataFrame([("S1-1", "S2-1")], "s1 string, s23 string")).collect()}
    assert got == {"repeated_rows": 1, "missing_rows": 1, "foreign_rows": 1, "repeated_in_list": 1, "left_ids_in_list": 1, "unknown_ids": 2, "used_more_than_once": 0, "warning_not_candidates": 2}
    (tmp_path / "f.tsv").write_text("a,b\nS1-1\tS2-1,,S9-1,S1-3\nbad\n\tS2-1\n")
    rules = {r["rule"]: r["n"] for r in R.file_rules(R.read_lines(spark, f"{tmp_path}/f.tsv"), ["a", "b"]).collect()}
    assert rules == {"empty_file": 0, "wrong_header": 1, "commas_for_tabs": 1, "malformed_rows": 1, "empty_row_id": 1, "empty_ids": 1, "wrong_prefix": 1, "left_ids_in_list": 1}
    assert rows(R.file_report(spark, f"{tmp_path}/none.tsv", ["a"])) == [("missing_file", 1)]
    assert {r["rule"]: r["n"] for r in R.file_report(spark, f"{tmp_path}/f.tsv", ["a", "b"]).collect()} == rules | {"missing_file": 0}
    (tmp_path / "e.tsv").write_text("")
    assert {r["rule"]: r["n"] for r in R.file_rules(R.read_lines(spark, f"{tmp_path}/e.tsv"), ["a"]).collect()}["empty_file"] == 1


def businesses(spark):
    words = ["Green Valley", "Silver Line", "Blue Harbor", "Stone Bridge", "Maple Grove", "Iron Works", "Quick Print", "Sun Flower", "North Star", "Red Oak"]
    s1, s23, truth = [], [], []
    for i in range(60):
        name, street = f"{words[i % 10]} {chr(65 + i % 26)}{chr(97 + i // 3)} Services", f"{i + 10} Oak Street, Springfield, Texas"
        s1.append((f"S1-{i}", f"{name} Inc", street, "US"))
        if i % 3:
            s23.append((f"S2-{i}", name.replace("Services", "Service") + " LLC", street.replace("Street", "St"), "US"))
            truth.append((f"S1-{i}", f"S2-{i}"))
        s23.append((f"S3-{i}", f"{words[(i + 3) % 10]} Trading", f"{i + 500} Elm Road, Dallas, TX", "US"))
    make = lambda r: spark.createDataFrame(r, "entity_id string, business_name string, business_address string, country string")
    return make(s1), make(s23), spark.createDataFrame(truth, "s1 string, s23 string")


def test_linkage_end_to_end(spark, tmp_path):
    s1, s23, truth = businesses(spark)
    out = linkage.link(spark, s1, s23, truth, f"{tmp_path}/out", linkage.Settings(rounds=3, dims=(24, 16), thresholds=[0.3, 0.5, 0.7]))
    found = truth.join(out["candidates"], ["s1", "s23"], "left_semi").count()
    assert found >= 38 and out["f05"] > 0.7
    assert spark.read.text(f"{tmp_path}/out/matching_results.tsv").count() >= 60
    # what was learned decides about the same records, read as if they had no truth
    learned = linkage.Learned.load(spark, f"{tmp_path}/out/learned")
    assert learned.threshold == out["threshold"] and learned.settings.dims == (24, 16)
    again = linkage.predict(spark, learned, s1, s23)
    got = again["matches"]
    hits = got.join(truth, ["s1", "s23"], "left_semi").count()
    assert hits > 0.8 * truth.count() and hits > 0.8 * got.count()
    assert again["scores"].count() == out["scores"].count()


def test_learned_tables(spark):
    """Regions from localities, and aliases from true pairs, take effect."""
    raw = [(f"S1-{i}", "Shop", f"{i} Oak Street, Springfield, Texas", "US") for i in range(5)] + [("S1-9", "Shop", "9 Elm Street, Springfield", "US")]
    raw += [(f"S1-{i}", "Shop", f"{i} Oak Street, Pine Town", "US") for i in range(20, 80)]
    other = [(f"S2-{i}", "Shop", f"{i} Oak Street, Pinewood", "US") for i in range(20, 80)]
    make = lambda rows_: spark.createDataFrame(rows_, "entity_id string, business_name string, business_address string, country string")
    s1, s23 = linkage.normalized(make(raw)), linkage.normalized(make(other))
    regions = linkage.learned_regions(s1)
    assert rows(regions) == [("US", "springfield", "tx", 5)]
    assert {r["entity_id"]: r["addr_region"] for r in linkage.normalized(make(raw), regions=regions).collect()}["S1-9"] == "tx"
    truth = spark.createDataFrame([(f"S1-{i}", f"S2-{i}") for i in range(20, 80)], "s1 string, s23 string")
    aliases = linkage.learned_aliases(s1, s23, truth)
    assert aliases == [("pinewood", "pine", 60)]
    assert {r["addr_locality"] for r in linkage.normalized(make(other), linkage.PlaceTables(learned=aliases)).collect()} == {"pine"}


def test_vectors_of_records(spark):
    raw = [("a", "Green Valley Inc", "12 Oak Street, Dallas, Texas", "US"), ("b", "Green Valley LLC", "12 Oak St, Dallas, TX", "US"), ("c", "Iron Works", "12 Oak Street, Dallas, TX", "US"), ("d", "Green Valley", "", "US")]
    n = linkage.normalized(spark.createDataFrame(raw, "entity_id string, business_name string, business_address string, country string"))
    w = linkage.part_weights(n).collect()
    assert {r["term"].split(":")[0] for r in w} == {f"{a}.{b}" for a, b, *_ in linkage.PARTS}
    v = {r["id"]: r["vector"] for r in linkage.record_vectors(n, (600, 400)).collect()}
    dot = lambda x, y: sum(p * q for p, q in zip(v[x], v[y], strict=True))
    assert all(len(x) == 1000 for x in v.values())
    assert dot("a", "a") == pytest.approx(1) and dot("d", "d") == pytest.approx(0.6) and dot("a", "b") == pytest.approx(1, abs=1e-5)
    assert dot("a", "d") == pytest.approx(0.6, abs=1e-5) and 0.3 < dot("a", "c") < 0.55


def test_projection_keeps_cosines(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    terms = [(i, f"t{t}", float(rng.random())) for i in range(30) for t in rng.choice(80, 12, replace=False)]
    exact = np.zeros((30, 80))
    for i, t, x in terms:
        exact[i, int(t[1:])] = x
    exact /= np.linalg.norm(exact, axis=1, keepdims=True)
    w = spark.createDataFrame([(i, f"t{t}", float(exact[i, t])) for i in range(30) for t in np.flatnonzero(exact[i])], "id int, term string, w double").repartition(3)
    got = np.array([r["vector"] for r in B.projected_vectors(w, 320).orderBy("id").collect()])
    assert np.abs(got @ got.T - exact @ exact.T).std() < 1.3 / np.sqrt(320)


def test_both_channels_find_the_true_pairs(spark):
    s1_raw, s23_raw, truth = linkage.part_records(spark, "/root/testdata/sf0.01")
    found = linkage.candidates(linkage.normalized(s1_raw), linkage.normalized(s23_raw), linkage.Settings()).cache()
    got = {r["channel"]: r["recall"] for r in B.recall(truth, found, {"all": F.lit(True), "vectors": F.col("cos") > 0}).collect()}
    assert got["all"] >= 0.9648 and got["vectors"] > 0.9


def test_arrivals(spark, tmp_path):
    s1, s23, truth = businesses(spark)
    s23.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(s23.schema).parquet(f"{tmp_path}/in")
    query = write_arrivals(stream, linkage.normalized(s1), f"{tmp_path}/out", f"{tmp_path}/cp")
    query.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out").select("s1", "s23")
    assert got.join(truth, ["s1", "s23"], "left_semi").count() > 10


def test_registered_features_have_both_channels(spark):
    got = linkage.features_of_parts(spark, "/root/testdata/sf0.001")
    assert got.where("b_rank_fwd < 99").count() > 0 and got.where("b_rank_rev < 99").count() > 0
    assert got.where("b_cos > 0").select("b_cos").distinct().count() > 10


def test_registered_scores_use_the_default_rounds(spark, monkeypatch):
    from recweld.plans import learning_queries

    monkeypatch.setattr(linkage, "labelled_features_of_parts", lambda *_: (None, linkage.normalized(businesses(spark)[1])))
    monkeypatch.setattr(linkage, "fit_scores", lambda described, names, rounds: (None, None, rounds))
    assert learning_queries.linkage_scores(spark, "") == linkage.Settings().rounds == 20

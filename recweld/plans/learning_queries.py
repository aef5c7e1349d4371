"""Learned tables, samples and models over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as E
from ..operators import learning as L
from ..sources.tables import materialized
from . import linkage
from .base import PAIRS_SQL, first_words, load, query, scored_pairs

_PLACES_SQL = "places AS (SELECT o_orderpriority AS country, o_custkey::VARCHAR AS loc, o_orderstatus AS region FROM orders)"
_MAP_SQL = _PLACES_SQL + ", n AS (SELECT country, loc, region, count(*) AS n FROM places GROUP BY 1, 2, 3), t AS (SELECT *, sum(n) OVER (PARTITION BY country, loc) AS total FROM n), m AS (SELECT country, loc, region AS imp_region, n FROM t WHERE total >= 3 AND n >= 0.9 * total)"


def _map(spark, sf):
    o = load(spark, sf, "orders").select(F.col("o_orderpriority").alias("country"), F.col("o_custkey").cast("string").alias("loc"), F.col("o_orderstatus").alias("region"))
    return L.region_map(o)


@query("WITH " + _MAP_SQL + " SELECT * FROM m")
def region_map(spark, sf):
    return _map(spark, sf)


@query("WITH " + _MAP_SQL + """, r AS (SELECT c_custkey AS entity_id, '1-URGENT' AS country, CASE WHEN c_custkey % 4 = 0 THEN 'X' ELSE '' END AS addr_region, [c_custkey::VARCHAR, (c_custkey + 1)::VARCHAR] AS locs FROM customer),
h AS (SELECT entity_id, imp_region FROM (SELECT entity_id, addr_region, country, unnest(locs) AS loc FROM r) JOIN m USING (country, loc) WHERE addr_region = '' QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY n DESC, imp_region, loc) = 1)
SELECT r.entity_id, coalesce(imp_region, addr_region) AS addr_region FROM r LEFT JOIN h USING (entity_id)""")
def region_impute(spark, sf):
    key = F.col("c_custkey")
    r = load(spark, sf, "customer").select(key.alias("entity_id"), F.lit("1-URGENT").alias("country"), F.when(key % 4 == 0, "X").otherwise("").alias("addr_region"), F.lit(False).alias("addr_blank"), F.array(key.cast("string"), (key + 1).cast("string")).alias("locs"))
    return L.impute_regions(r, _map(spark, sf)).select("entity_id", "addr_region")


@query("""WITH p AS (SELECT a.p_partkey AS s1, b.p_partkey AS s23, string_split(a.p_name, ' ') AS a, string_split(b.p_name, ' ') AS b FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey),
l AS (SELECT list_filter(list_distinct(a), lambda x: NOT list_contains(b, x)) AS x, list_filter(list_distinct(b), lambda x: NOT list_contains(a, x)) AS y FROM p), n AS (SELECT variant, canonical, count(*) AS n FROM (SELECT variant, unnest(x) AS canonical FROM (SELECT unnest(y) AS variant, x FROM l WHERE len(x) = 1 OR len(y) = 1)) GROUP BY 1, 2),
t AS (SELECT *, sum(n) OVER (PARTITION BY variant) AS total FROM n), w AS (SELECT DISTINCT p_partkey AS id, unnest(string_split(p_name, ' ')) AS part FROM part)
SELECT variant, canonical, n FROM t WHERE n >= 2 AND n >= 0.1 * total AND (SELECT count(*) FROM w x JOIN w y ON x.id = y.id WHERE x.part = variant AND y.part = canonical) <= 0.5 * (SELECT count(*) FROM w WHERE part = variant)""")
def alias_mining(spark, sf):
    """Pairs of the same brand and size are counted by their names, as a larger table has far more pairs than kinds of pairs."""
    p = load(spark, sf, "part").select("p_partkey", "p_brand", "p_size", "p_name")
    n = L.ordered_pair_counts(p, ["p_brand", "p_size"], "p_partkey", "p_name")
    pairs = n.select(F.split("a", " ").alias("a"), F.split("b", " ").alias("b"), "n")
    parts = p.select(F.col("p_partkey").alias("id"), F.explode(F.split("p_name", " ")).alias("part"))
    return L.mine_aliases(pairs, parts, min_count=2, purity=0.1, together=0.5)


_STRATA_SQL = PAIRS_SQL + """, s AS (SELECT s1, s23, CASE WHEN score > 0.9 THEN 'POS' WHEN score >= 0.75 THEN 'H1' WHEN score >= 0.6 THEN 'H2' ELSE 'E' END AS stratum, ('0x' || substr(md5(s1::VARCHAR || '-' || s23::VARCHAR), 1, 8))::BIGINT / 4294967296.0 AS u FROM pairs),
c AS (SELECT stratum, count(*) AS n, CASE stratum WHEN 'E' THEN least(1.0, 20.0 / count(*)) WHEN 'H2' THEN least(1.0, 10.0 / count(*)) ELSE 1.0 END AS rate FROM s GROUP BY 1)"""


@query("WITH " + _STRATA_SQL + " SELECT stratum, count(*) AS n, round(sum(CASE stratum WHEN 'H1' THEN 2.0 ELSE 1.0 END / rate), 6) AS weight_sum FROM s JOIN c USING (stratum) WHERE u < rate GROUP BY stratum")
def strata_sample(spark, sf):
    p = scored_pairs(spark, sf).select("s1", "s23", L.stratum(F.col("score") > 0.9, [("H1", F.col("score") >= 0.75), ("H2", F.col("score") >= 0.6)]).alias("stratum"))
    u = E.md5_uniform(F.concat_ws("-", F.col("s1").cast("string"), F.col("s23").cast("string")))
    out = L.stratified_sample(p, "stratum", u, {"E": 20, "H2": 10}, {"H1": 2.0})
    return out.groupBy("stratum").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight_sum"))


def _context_sql(p: str, by: str, tie: str) -> str:
    return f"""{p}w AS (SELECT s1, s23, score, rank() OVER (PARTITION BY {by} ORDER BY score DESC) AS r, count(*) OVER (PARTITION BY {by}) AS n, sum((score >= 0.75)::INT) OVER (PARTITION BY {by})::BIGINT - (score >= 0.75)::INT AS sure, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, {tie}) AS rn FROM pairs),
{p}o AS (SELECT *, CASE WHEN rn = 1 THEN max(CASE WHEN rn = 2 THEN score END) OVER (PARTITION BY {by}) ELSE max(score) OVER (PARTITION BY {by}) END AS other FROM {p}w),
{p} AS (SELECT s1, s23, r AS {p}_p_rank, n AS {p}_p_n, sure AS {p}_sure_others, other AS {p}_p_other, round(score - coalesce(other, 0), 6) AS {p}_p_margin FROM {p}o)"""


@query("WITH " + PAIRS_SQL + ", " + _context_sql("c1", "s1", "s23") + ", " + _context_sql("c23", "s23", "s1") + """, same AS (SELECT s1, s23, sum((score >= 0.75)::INT) OVER (PARTITION BY s1, src)::BIGINT - (score >= 0.75)::INT AS c1_sure_same_source, count(*) OVER (PARTITION BY s1, src) AS c1_n_same_source FROM pairs)
SELECT * FROM c1 JOIN c23 USING (s1, s23) JOIN same USING (s1, s23)""")
def anchor_context(spark, sf):
    """Standing of a pair on both sides, and among its record's pairs of the same source."""
    out = L.group_context(scored_pairs(spark, sf).select("s1", "s23", "src", F.col("score").alias("p1")), confident=0.75)
    return out.select(*[F.round(c, 6).alias(c) if c.endswith("margin") else F.col(c) for c in out.columns if c not in ("src", "p1")])


@query("WITH " + PAIRS_SQL + """, a AS (SELECT s1, s23 AS anchor, name2 AS other FROM pairs WHERE score >= 0.75 QUALIFY row_number() OVER (PARTITION BY s1 ORDER BY score DESC, s23) <= 4)
SELECT p.s1, p.s23, count(a.anchor) AS anc_n, max((split_part(name2, ' ', 4) = split_part(other, ' ', 4))::INT::DOUBLE) AS anc_hnum, max((name2 = other)::INT::DOUBLE) AS anc_exact_name, max((split_part(name2, ' ', 3) = split_part(other, ' ', 3))::INT::DOUBLE) AS anc_exact_addr
FROM pairs p LEFT JOIN a ON a.s1 = p.s1 AND a.anchor <> p.s23 GROUP BY 1, 2""")
def anchor_similarity(spark, sf):
    """The columns that SQL has; the similarities of strings among them are checked in the tests."""
    p = scored_pairs(spark, sf)
    word = lambda i: F.split_part("name2", F.lit(" "), F.lit(i))
    names = p.select(F.col("s23").alias("id"), F.col("name2").alias("name"), F.col("name2").alias("skel"), word(3).alias("addr"), word(4).alias("hnum")).distinct()
    scores = p.select("s1", "s23", F.col("score").alias("p1"))
    return L.anchor_features(scores, L.anchors(scores, confident=0.75), names).select("s1", "s23", "anc_n", "anc_hnum", "anc_exact_name", "anc_exact_addr")


_FOUR = ["f1", "f2", "f3", "f4"]


def _described(p):
    return p.withColumns({"y": (first_words("name1", 3) == first_words("name2", 3)).cast("double"), "is_val": E.crc_split("s1"), "f1": F.length("name1").cast("double"), "f2": F.length("name2").cast("double"), "f3": F.when(F.col("src") == 2, F.col("score")), "f4": F.col("score")})


def _labelled(spark, sf):
    """All pairs that share a key, without a cap, as more than KEY_CAP records may share every key of a larger table; stored, as
    learners read them many times."""
    return materialized(_described(scored_pairs(spark, sf, None)).select("s1", "s23", "y", "is_val", *_FOUR))


def _counted(spark, sf):
    """The same pairs, counted (n) by what a model sees of them: a larger table has far more pairs than kinds of pairs."""
    p = _described(scored_pairs(spark, sf, None, counted=True))
    return materialized(p.groupBy("y", "is_val", *_FOUR).agg(F.sum("n").cast("double").alias("n")))


@query()
def gbt_scores(spark, sf):
    """Boosted trees on four features of name pairs."""
    d = L.filled(_labelled(spark, sf), ["f1", "f2", "f3", "f4"])
    model = L.fitted(L.gbt(["f1", "f2", "f3", "f4"], rounds=5, depth=3), d.where(~F.col("is_val")))
    return L.scored(model, d, ["f1", "f2", "f3", "f4"]).select("s1", "s23", "p")


@query()
def oof_stack_scores(spark, sf):
    """Cross-fitted first-stage scores."""
    return L.out_of_fold(_labelled(spark, sf), ["f1", "f2", "f3", "f4"], rounds=3).select("s1", "s23", F.col("p1").alias("p"))


@query()
def linkage_scores(spark, sf):
    """Both stages of scores on all features of parts read as records."""
    described, s23 = linkage.labelled_features_of_parts(spark, sf)
    return linkage.fit_scores(described, linkage.anchor_texts(s23), linkage.Settings().rounds)[2]


@query()
def ablation(spark, sf):
    """Average precision of models on five subsets of features, learned in all rounds from all pairs that are not held out."""
    d = _counted(spark, sf)
    groups = {"all": _FOUR, "without the first": _FOUR[1:], "without the score": _FOUR[:3], "lengths": _FOUR[:2], "score": _FOUR[3:]}
    return L.ablation(d.where(~F.col("is_val")), d.where("is_val"), groups, share=1.0, weight="n")


@query()
def hyper_parameters(spark, sf):
    """Average precision of models with four settings."""
    d = _counted(spark, sf)
    settings = [{"rounds": 2, "depth": 2}, {"rounds": 2, "depth": 4}, {"rounds": 3, "depth": 3, "stepSize": 0.3}, {"rounds": 3, "depth": 3, "subsamplingRate": 0.5}]
    return L.sweep(d.where(~F.col("is_val")), d.where("is_val"), _FOUR, settings, weight="n")


@query()
def feature_importance(spark, sf):
    """Gains of a model of all rounds, learned from all pairs, whose classes count the same."""
    d = L.filled(L.dealt(_counted(spark, sf), "n"), _FOUR)
    model = L.fitted(L.gbt(_FOUR, weight="n"), L.balanced(d, "y", "n"))
    return spark.createDataFrame(L.importance(model, _FOUR), "feature string, gain double")

"""Candidate generation over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.names import skeleton
from ..operators import blocking as B
from ..operators import evaluation as V
from ..operators.blocking import KEY_CAP
from .base import PAIRS_SQL, RECORDS_SQL, THREE, TWO, first_words, load, query, records, scored_pairs, sides
from .feature_queries import skeleton_sql

_CAPPED = f"""k1 AS (SELECT s1, country || '|' || {THREE("name")} AS key FROM s1 WHERE name <> ''), k23 AS (SELECT s23, country || '|' || {THREE("name")} AS key FROM s23 WHERE name <> ''),
c1 AS (SELECT key FROM k1 GROUP BY key HAVING count(*) <= {KEY_CAP}), c23 AS (SELECT key FROM k23 GROUP BY key HAVING count(*) <= {KEY_CAP})"""


@query("WITH " + RECORDS_SQL + ", " + _CAPPED + " SELECT s1, count(*) AS n_cand FROM k1 JOIN k23 USING (key) WHERE key IN (SELECT key FROM c1) AND key IN (SELECT key FROM c23) GROUP BY s1")
def exact_key_blocking(spark, sf):
    """Candidates by the first three words of the name within the country."""
    s1, s23 = sides(spark, sf)
    key = F.concat_ws("|", F.col("country"), first_words("name", 3)).alias("key")
    pairs = B.shared_key_pairs(s1.where("name <> ''").select("s1", key), s23.where("name <> ''").select("s23", key))
    return pairs.groupBy("s1").agg(F.count("*").alias("n_cand"))


_NORMALIZED_SQL = f"""nrm AS (SELECT doc_id AS id, src = 1 AS side, country, {TWO("name")} AS core, replace({TWO("name")}, ' ', '') AS nospace, array_to_string(list_transform(string_split({TWO("name")}, ' '), lambda t: {skeleton_sql("t")}), ' ') AS skel,
 CASE WHEN doc_id % 2 = 0 THEN split_part(name, ' ', 3) ELSE '' END AS region, split_part(name, ' ', 4) AS hnum, split_part(name, ' ', 2) || '|' || split_part(name, ' ', 3) AS places FROM rec),
wrd AS (SELECT DISTINCT id, side, country, region, hnum, places, unnest(string_split(core, ' ')) AS w FROM nrm)"""


@query("WITH " + RECORDS_SQL + ", " + _NORMALIZED_SQL + f""", a AS (SELECT DISTINCT id, side, key FROM (
 SELECT id, side, country || '|n|' || nospace || '|' || region AS key FROM nrm WHERE nospace <> '' UNION ALL SELECT id, side, country || '|s|' || skel || '|' || region FROM nrm WHERE skel <> ''
 UNION ALL SELECT id, side, country || '|th|' || w || '|' || hnum || '|' || region FROM wrd WHERE length(w) >= 2 AND hnum <> '' UNION ALL SELECT id, side, country || '|tl|' || w || '|' || unnest(string_split(places, '|')) FROM wrd WHERE length(w) >= 2
 UNION ALL SELECT id, side, country || '|nm|' || nospace FROM nrm WHERE length(nospace) >= 6 UNION ALL SELECT id, side, country || '|sk|' || skel FROM nrm WHERE length(skel) >= 5)),
k AS (SELECT * FROM a WHERE (side, key) IN (SELECT side, key FROM a GROUP BY side, key HAVING count(*) <= {KEY_CAP}))
SELECT x.id AS s1, y.id AS s23, count(*) AS n_keys FROM k x JOIN k y ON x.key = y.key AND x.side AND NOT y.side GROUP BY 1, 2""")
def blocking_key_families(spark, sf):
    """All six families of keys."""
    word = lambda i: F.split_part("name", F.lit(" "), F.lit(i))
    r = records(spark, sf).withColumn("name_core", first_words("name", 2))
    r = r.withColumns({"name_nospace": F.replace("name_core", F.lit(" "), F.lit("")), "name_skel": F.array_join(F.transform(F.split("name_core", " "), skeleton), " "), "addr_hnum": word(4), "addr_locality": F.concat_ws("|", word(2), word(3))})
    r = r.withColumns({"addr_region": F.when(F.col("doc_id") % 2 == 0, word(3)).otherwise(""), "entity_id": F.col("doc_id")})
    left, right = (B.key_families(r.where(side)) for side in ("src = 1", "src <> 1"))
    return B.shared_key_pairs(left.withColumnRenamed("entity_id", "s1"), right.withColumnRenamed("entity_id", "s23"))


@query("WITH " + RECORDS_SQL + f""", x AS (SELECT country, replace({THREE("name")}, ' ', '') AS key, s1 FROM s1 WHERE name <> ''), a AS (SELECT * FROM x QUALIFY count(*) OVER (PARTITION BY country, key) = 1)
SELECT a.s1, s23.s23 FROM a JOIN s23 ON a.country = s23.country AND a.key = replace({THREE("s23.name")}, ' ', '')""")
def baseline_key_match(spark, sf):
    s1, s23 = (df.where("name <> ''").withColumn("key", B.baseline_key(first_words("name", 3))) for df in sides(spark, sf))
    return B.unique_key_pairs(s1.select("country", "key", "s1"), s23.select("country", "key", "s23"))


_TERMS = "t AS (SELECT p_partkey AS id, unnest(string_split(p_name, ' ')) AS term FROM part)"


@query("WITH " + _TERMS + ", n AS (SELECT count(DISTINCT id) AS n FROM t) SELECT term AS t, count(DISTINCT id) AS df, round(ln((1.0 + max(n)) / (1.0 + count(DISTINCT id))) + 1, 6) AS idf FROM t, n GROUP BY term")
def token_idf(spark, sf):
    terms = load(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.explode(F.split("p_name", " ")).alias("term"))
    return B.idf(terms).select(F.col("term").alias("t"), "df", F.round("idf", 6).alias("idf"))


@query("WITH " + PAIRS_SQL + """, names AS (SELECT s1 AS id, name FROM s1 UNION ALL SELECT s23, name FROM s23),
t AS (SELECT id, substr(' ' || w || ' ', i, 3) AS term FROM (SELECT id, unnest(string_split(name, ' ')) AS w FROM names), range(1, 60) r(i) WHERE w <> '' AND i <= length(w)),
tf AS (SELECT id, term, count(*) AS tf FROM t GROUP BY 1, 2), n AS (SELECT count(DISTINCT id) AS n FROM t), d AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
w0 AS (SELECT id, term, (1 + ln(tf)) * (ln((1.0 + n) / (1.0 + df)) + 1) AS w FROM tf JOIN d USING (term), n), w AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM w0),
dots AS (SELECT p.s1, p.s23, sum(a.w * b.w) AS c FROM pairs p JOIN w a ON a.id = p.s1 JOIN w b ON b.id = p.s23 AND a.term = b.term GROUP BY 1, 2)
SELECT p.s1, p.s23, round(coalesce(c, 0.0), 6) AS cos FROM pairs p LEFT JOIN dots USING (s1, s23)""")
def char_gram_cosine(spark, sf):
    s1, s23 = sides(spark, sf)
    names = s1.select(F.col("s1").alias("id"), "name").unionByName(s23.select(F.col("s23").alias("id"), "name"))
    weights = B.tfidf(names.select("id", F.explode(B.char_grams(F.col("name"))).alias("term")))
    return B.pair_cosines(scored_pairs(spark, sf).select("s1", "s23"), weights, weights).select("s1", "s23", F.round("cos", 6).alias("cos"))


_VECTORS = """v AS (SELECT label, vec_id, embedding FROM embeddings),
c AS (SELECT a.vec_id AS s1, b.vec_id AS s23, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))
 / sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS cos
 FROM v a JOIN v b ON a.label = b.label AND a.vec_id % 3 = 0 AND b.vec_id % 3 <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY cos DESC, s23) AS f, row_number() OVER (PARTITION BY s23 ORDER BY cos DESC, s1) AS b FROM c),
near AS (SELECT s1, s23, cos, CASE WHEN f <= 10 THEN f END AS rank_fwd, CASE WHEN b <= 2 THEN b END AS rank_rev FROM r WHERE (f <= 10 OR b <= 2) AND cos > 0.05)"""


def _near(spark, sf):
    v = load(spark, sf, "embeddings").select(F.col("label").alias("group"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    return B.nearest_both_ways(v.where("id % 3 = 0"), v.where("id % 3 <> 0"))


@query("WITH " + _VECTORS + " SELECT s1 AS q, s23 AS b, rank_fwd AS rank_f, rank_rev AS rank_r FROM near")
def vector_topk_bidirectional(spark, sf):
    return _near(spark, sf).select(F.col("s1").alias("q"), F.col("s23").alias("b"), F.col("rank_fwd").alias("rank_f"), F.col("rank_rev").alias("rank_r"))


_UNION = _VECTORS + """, keyed AS (SELECT a.vec_id AS s1, b.vec_id AS s23, 1::BIGINT AS n_keys FROM v a JOIN v b ON a.vec_id % 3 = 0 AND b.vec_id % 3 <> 0 AND a.vec_id // 7 = b.vec_id // 7),
cand AS (SELECT coalesce(k.s1, n.s1) AS s1, coalesce(k.s23, n.s23) AS s23, coalesce(n_keys, 0)::BIGINT AS n_keys, coalesce(cos, 0.0) AS cos, rank_fwd, rank_rev FROM keyed k FULL JOIN near n ON k.s1 = n.s1 AND k.s23 = n.s23)"""


def _candidates(spark, sf):
    v = load(spark, sf, "embeddings").select("vec_id", F.expr("cast(vec_id div 7 as string)").alias("key"))
    keyed = B.shared_key_pairs(v.where("vec_id % 3 = 0").select(F.col("vec_id").alias("s1"), "key"), v.where("vec_id % 3 <> 0").select(F.col("vec_id").alias("s23"), "key"))
    return B.union_candidates(keyed, B.merge_directions(_near(spark, sf)))


@query("WITH " + _UNION + " SELECT s1, s23, n_keys, cos, rank_fwd, rank_rev FROM cand")
def blocking_union(spark, sf):
    return _candidates(spark, sf)


_CHANNELS = {"keys": "n_keys > 0", "forward": "rank_fwd IS NOT NULL", "forward_5": "coalesce(rank_fwd, 999) <= 5", "reverse": "rank_rev IS NOT NULL", "all": "true"}


@query("WITH " + _UNION + """, truth AS (SELECT s1, s23 FROM c WHERE cos > 0.3), h AS (SELECT t.s1, c.s1 IS NOT NULL AS hit, n_keys, rank_fwd, rank_rev FROM truth t LEFT JOIN cand c ON t.s1 = c.s1 AND t.s23 = c.s23),
f AS (""" + " UNION ALL ".join(f"SELECT '{k}' AS channel, s1, coalesce(hit AND {v}, false)::INT AS hit FROM h" for k, v in _CHANNELS.items()) + """),
e AS (SELECT channel, s1, count(*) AS n, sum(hit) AS hit FROM f GROUP BY 1, 2)
SELECT channel, sum(n)::BIGINT AS pairs, sum(hit)::BIGINT AS found, round(sum(hit) / sum(n), 6) AS recall, round(avg((hit = n)::INT), 6) AS entity_recall FROM e GROUP BY channel""")
def blocking_recall(spark, sf):
    v = load(spark, sf, "embeddings").select(F.col("label").alias("group"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    a, b = v.where("id % 3 = 0"), v.where("id % 3 <> 0")
    truth = B.pairs_above(a, b, 0.3)
    out = B.recall(truth, _candidates(spark, sf), {k: F.expr(x) for k, x in _CHANNELS.items()})
    return out.select("channel", "pairs", "found", F.round("recall", 6).alias("recall"), F.round("entity_recall", 6).alias("entity_recall"))


@query("WITH " + _UNION + """, truth AS (SELECT s1, s23 FROM c WHERE cos > 0.3), g AS (SELECT unnest([3, 5, 10]) AS depth), w AS (SELECT depth, with_keys FROM g, (SELECT true AS with_keys UNION ALL SELECT false)),
k AS (SELECT * FROM cand, w WHERE coalesce(rank_fwd, 1000000) <= depth OR rank_rev IS NOT NULL OR (with_keys AND n_keys > 0))
SELECT depth, with_keys, round(sum(((s1, s23) IN (SELECT s1, s23 FROM truth))::INT) / (SELECT count(*) FROM truth), 6) AS recall, round(count(*) / (SELECT count(*)::DOUBLE FROM v WHERE vec_id % 3 = 0), 6) AS per_record FROM k GROUP BY 1, 2""")
def recall_cost_grid(spark, sf):
    v = load(spark, sf, "embeddings").select(F.col("label").alias("group"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    left = v.where("id % 3 = 0")
    truth = B.pairs_above(left, v.where("id % 3 <> 0"), 0.3)
    out = V.recall_cost_grid(truth, _candidates(spark, sf), left, [3, 5, 10])
    return out.select("depth", "with_keys", F.round("recall", 6).alias("recall"), F.round("per_record", 6).alias("per_record"))

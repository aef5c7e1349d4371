"""Projections, joins, aggregates, windows, set operations and selections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..operators import selection as S
from ..sources.tables import explode_truth, id_lists, sample_rows
from .base import PAIRS_SQL, RECORDS_SQL, load, query, records, scored_pairs, sides


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN 'small' WHEN l_discount > 0.05 THEN 'reduced' ELSE 'plain' END AS class,
 round(least(greatest(l_extendedprice, 1000.0), 50000.0), 6) AS clipped, coalesce(nullif(l_returnflag, 'N'), '') AS flag FROM lineitem""")
def proj_case(spark, sf):
    kind = F.when(F.col("l_quantity") < 10, "small").when(F.col("l_discount") > 0.05, "reduced").otherwise("plain")
    flag = F.coalesce(F.nullif("l_returnflag", F.lit("N")), F.lit(""))
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", kind.alias("class"), F.round(E.clip("l_extendedprice", 1000.0, 50000.0), 6).alias("clipped"), flag.alias("flag"))


_BINS = "SELECT bucket, count(*) AS n, round(avg(n_chars), 6) AS mean FROM (SELECT n_chars, CASE {} ELSE 4 END AS bucket FROM documents) GROUP BY bucket"
_EDGES = [100.0, 1000.0, 3000.0, 10000.0]


def _binned(spark, sf, left):
    return load(spark, sf, "documents").groupBy(E.bin_of("n_chars", _EDGES, left).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"))


@query(_BINS.format(" ".join(f"WHEN n_chars <= {int(e)} THEN {i}" for i, e in enumerate(_EDGES))))
def bin_right_closed(spark, sf):
    return _binned(spark, sf, False)


@query(_BINS.format(" ".join(f"WHEN n_chars < {int(e)} THEN {i}" for i, e in enumerate(_EDGES))))
def bin_left_closed(spark, sf):
    return _binned(spark, sf, True)


_WEIGHTS = {"1-URGENT": 5, "2-HIGH": 4, "3-MEDIUM": 3, "4-NOT SPECIFIED": 2, "5-LOW": 1}


@query("""SELECT o_orderpriority AS priority, CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 4 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 2 WHEN '5-LOW' THEN 1 END AS weight, count(*) AS n
 FROM orders GROUP BY 1, 2""")
def map_lookup(spark, sf):
    return load(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("priority"), E.lookup("o_orderpriority", _WEIGHTS).alias("weight")).agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, nullif(l_tax, 0) AS a, nullif(l_discount, 0) AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN round(least(a, b), 6) END AS lo, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN round(greatest(a, b), 6) END AS hi FROM x""")
def null_guarded_minmax(spark, sf):
    a, b = F.nullif("l_tax", F.lit(0.0)), F.nullif("l_discount", F.lit(0.0))
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(E.strict_least(a, b), 6).alias("lo"), F.round(E.strict_greatest(a, b), 6).alias("hi"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0.0 ELSE round(1000.0 / nullif(o_totalprice, 0), 6) END AS per FROM orders")
def safe_ratio(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", F.round(E.safe_divide(F.lit(1000.0), F.when(F.col("o_orderstatus") == "F", 0.0).otherwise(F.col("o_totalprice"))), 6).alias("per"))


@query("""SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(replace(source, 'src', '1,'), ',')) AS part FROM documents) WHERE part <> '' GROUP BY doc_id""")
def explode_split(spark, sf):
    parts = F.explode(F.split(F.replace("source", F.lit("src"), F.lit("1,")), ","))
    return load(spark, sf, "documents").select("doc_id", parts.alias("part")).where("part <> ''").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT o_custkey AS key, count(*) AS a FROM orders WHERE o_totalprice > 200000 GROUP BY 1), b AS (SELECT c_custkey AS key, c_nationkey AS b FROM customer WHERE c_acctbal > 0)
SELECT coalesce(a.key, b.key) AS key, a.a, b.b FROM a FULL JOIN b ON a.key = b.key""")
def join_full_coalesce(spark, sf):
    a = load(spark, sf, "orders").where("o_totalprice > 200000").groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("a"))
    b = load(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("b"))
    return a.join(b, ["key"], "full")


@query("SELECT c_custkey AS custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def join_left_fill0(spark, sf):
    n = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.count("*").alias("n"))
    return load(spark, sf, "customer").select(F.col("c_custkey").alias("custkey")).join(n, "custkey", "left").select("custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT c_custkey AS custkey, n FROM (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) RIGHT JOIN customer ON c_custkey = o_custkey")
def join_right(spark, sf):
    n = load(spark, sf, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("custkey")).agg(F.count("*").alias("n"))
    return n.join(load(spark, sf, "customer").select(F.col("c_custkey").alias("custkey")), "custkey", "right")


@query("SELECT c_custkey AS custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def join_semi(spark, sf):
    o = load(spark, sf, "orders").where("o_orderpriority = '1-URGENT'")
    return load(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select(F.col("c_custkey").alias("custkey"))


@query("SELECT c_custkey AS custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def join_anti(spark, sf):
    o = load(spark, sf, "orders").where("o_orderpriority = '1-URGENT'")
    return load(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.col("c_custkey").alias("custkey"))


@query("SELECT a.l_orderkey AS orderkey, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber <> b.l_linenumber AND a.l_returnflag = b.l_returnflag GROUP BY 1")
def self_join_neq(spark, sf):
    x = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("orderkey"), "l_returnflag", "l_linenumber")
    y = x.withColumnRenamed("l_linenumber", "other")
    return x.join(y, ["orderkey", "l_returnflag"]).where("l_linenumber <> other").groupBy("orderkey").agg(F.count("*").alias("n"))


def _kinds(spark, sf):
    c = load(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("nationkey"))
    return c, load(spark, sf, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("nationkey"))


@query("SELECT kind, nationkey, count(*) AS n FROM (SELECT 'customer' AS kind, c_nationkey AS nationkey FROM customer UNION ALL SELECT 'supplier', s_nationkey FROM supplier) GROUP BY 1, 2")
def union_all(spark, sf):
    c, s = _kinds(spark, sf)
    return c.unionByName(s).groupBy("kind", "nationkey").agg(F.count("*").alias("n"))


@query("SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, sf):
    c, s = _kinds(spark, sf)
    return c.select("nationkey").union(s.select("nationkey")).distinct()


@query("SELECT c_nationkey AS nationkey, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT s_nationkey, NULL, round(s_acctbal, 6) FROM supplier")
def union_diagonal(spark, sf):
    c = load(spark, sf, "customer").select(F.col("c_nationkey").alias("nationkey"), F.col("c_mktsegment").alias("segment"))
    s = load(spark, sf, "supplier").select(F.col("s_nationkey").alias("nationkey"), F.round("s_acctbal", 6).alias("balance"))
    return c.unionByName(s, allowMissingColumns=True)


@query("SELECT c_nationkey AS nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
def set_intersect(spark, sf):
    return load(spark, sf, "customer").select(F.col("c_nationkey").alias("nationkey")).intersect(load(spark, sf, "supplier").where("s_acctbal > 0").select("s_nationkey"))


@query("SELECT c_nationkey AS nationkey FROM customer WHERE c_acctbal > 0 EXCEPT ALL SELECT s_nationkey FROM supplier")
def set_except(spark, sf):
    return load(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_nationkey").alias("nationkey")).exceptAll(load(spark, sf, "supplier").select("s_nationkey"))


@query("SELECT p_name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) <= 30")
def agg_group_cap(spark, sf):
    return load(spark, sf, "part").groupBy("p_name").agg(F.count("*").alias("n")).where("n <= 30")


@query("SELECT c_custkey AS custkey, coalesce(list, '') AS list FROM customer LEFT JOIN (SELECT o_custkey, string_agg(DISTINCT o_orderkey::VARCHAR, ',' ORDER BY o_orderkey::VARCHAR) AS list FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def agg_string_list(spark, sf):
    pairs = load(spark, sf, "orders").select(F.col("o_custkey").alias("s1"), F.col("o_orderkey").cast("string").alias("s23"))
    out = id_lists(load(spark, sf, "customer").select(F.col("c_custkey").alias("s1")), pairs)
    return out.select(F.col("source1_entity_id").alias("custkey"), F.col("matched_entity_ids").alias("list"))


@query("""WITH t AS (SELECT doc_id, string_agg(other::VARCHAR, ',' ORDER BY other) AS list FROM (SELECT a.doc_id, b.doc_id AS other FROM documents a JOIN documents b ON a.text = b.text AND a.doc_id < b.doc_id) GROUP BY 1)
SELECT doc_id::VARCHAR AS s1, unnest(string_split(list, ',')) AS s23 FROM t""")
def truth_explode(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", F.md5("text").alias("k"))
    pairs = d.join(d.select(F.col("doc_id").alias("other"), "k"), "k").where("doc_id < other")
    lists = pairs.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("other")), ",").alias("matched_entity_ids"))
    return explode_truth(lists.select(F.col("doc_id").cast("string").alias("source1_entity_id"), "matched_entity_ids"))


@query("SELECT n, count(*) AS groups, count(*) * n AS members FROM (SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1) GROUP BY n")
def agg_distinct_dups(spark, sf):
    dups = load(spark, sf, "documents").groupBy("text").agg(F.count("*").alias("n")).where("n > 1")
    return dups.groupBy("n").agg(F.count("*").alias("groups")).select("n", "groups", (F.col("groups") * F.col("n")).alias("members"))


@query("SELECT o_custkey AS custkey, o_orderkey AS orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def agg_argmax_row(spark, sf):
    best = F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey")))
    return load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(best.alias("orderkey"))


@query("SELECT lang, round(median(n_chars), 6) AS median, max(n_chars) AS most, count(DISTINCT source) AS sources FROM documents GROUP BY lang")
def agg_median(spark, sf):
    return load(spark, sf, "documents").groupBy("lang").agg(F.round(F.percentile("n_chars", F.lit(0.5)), 6).alias("median"), F.max("n_chars").alias("most"), F.countDistinct("source").alias("sources"))


_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("SELECT " + ", ".join(f"round(avg({c}), 6) AS {c}_mean, round(stddev_samp({c}), 4) AS {c}_sd, round(min({c}), 6) AS {c}_min, round(max({c}), 6) AS {c}_max, round(avg(({c} IS NULL)::INT), 6) AS {c}_null" for c in _NUMBERS) + " FROM lineitem")
def agg_profile_wide(spark, sf):
    out = []
    for c in _NUMBERS:
        out += [F.round(F.avg(c), 6).alias(f"{c}_mean"), F.round(F.stddev_samp(c), 4).alias(f"{c}_sd"), F.round(F.min(c), 6).alias(f"{c}_min"), F.round(F.max(c), 6).alias(f"{c}_max"), F.round(F.avg(F.col(c).isNull().cast("int")), 6).alias(f"{c}_null")]
    return load(spark, sf, "lineitem").agg(*out)


@query("WITH n AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2) SELECT lang, source, n, round(n / sum(n) OVER (PARTITION BY lang), 6) AS share FROM n")
def join_totals_back(spark, sf):
    n = load(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("lang")), 6))


@query("WITH " + PAIRS_SQL + """, w AS (SELECT s1, s23, score, rank() OVER (PARTITION BY s1 ORDER BY score DESC) AS rank, count(*) OVER (PARTITION BY s1) AS n, max(score) OVER (PARTITION BY s1) AS top1,
 max(score) OVER (PARTITION BY s1 ORDER BY score DESC, s23 ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt, row_number() OVER (PARTITION BY s1 ORDER BY score DESC, s23) AS rn FROM pairs),
m AS (SELECT *, max(CASE WHEN rn = 2 THEN score END) OVER (PARTITION BY s1) AS top2 FROM w)
SELECT s1, s23, rank, n, round(CASE WHEN score >= top1 THEN score - CASE WHEN n > 1 THEN top2 ELSE 0 END ELSE score - top1 END, 6) AS margin FROM m""")
def win_rank_margin(spark, sf):
    p = S.with_rank_margin(scored_pairs(spark, sf), "s1", "score", "s23", "")
    return p.select("s1", "s23", "rank", "n", F.round("margin", 6).alias("margin"))


@query("""WITH w AS (SELECT l_orderkey, l_linenumber, (l_quantity >= 25)::INT AS f, l_extendedprice AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rn FROM lineitem)
SELECT l_orderkey, l_linenumber, sum(f) OVER (PARTITION BY l_orderkey)::BIGINT - f AS others,
 round(CASE WHEN rn = 1 THEN max(CASE WHEN rn = 2 THEN x END) OVER (PARTITION BY l_orderkey) ELSE max(x) OVER (PARTITION BY l_orderkey) END, 6) AS other_max FROM w""")
def win_other_counts(spark, sf):
    x = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") >= 25).cast("long").alias("f"), F.col("l_extendedprice").alias("x"))
    x = x.withColumn("others", S.sum_of_others("f", "l_orderkey")).withColumn("other_max", S.max_of_others("x", "l_orderkey", "l_linenumber"))
    return x.select("l_orderkey", "l_linenumber", "others", F.round("other_max", 6).alias("other_max"))


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY value DESC, event_id ROWS UNBOUNDED PRECEDING), 4) AS cum, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events")
def win_running_sum(spark, sf):
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return load(spark, sf, "events").select("event_id", F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("cum"), F.row_number().over(w).cast("long").alias("k"))


@query("SELECT o_custkey AS custkey, o_orderkey AS orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders QUALIFY rn <= 4")
def topk_per_group(spark, sf):
    o = load(spark, sf, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"), "o_totalprice")
    return S.top_k(o, "custkey", [F.desc("o_totalprice"), "orderkey"], 4, "rn").select("custkey", "orderkey", F.col("rn").cast("long").alias("rn"))


@query("SELECT c_custkey AS custkey, c_nationkey AS nationkey FROM customer ORDER BY c_nationkey, c_acctbal DESC, c_custkey LIMIT 100")
def sort_limit(spark, sf):
    return load(spark, sf, "customer").orderBy("c_nationkey", F.desc("c_acctbal"), "c_custkey").limit(100).select(F.col("c_custkey").alias("custkey"), F.col("c_nationkey").alias("nationkey"))


@query("SELECT doc_id, row_number() OVER (ORDER BY lang, doc_id) - 1 AS i FROM documents")
def canonical_order(spark, sf):
    return S.with_index(load(spark, sf, "documents").select("lang", "doc_id"), ["lang", "doc_id"], "i").select("doc_id", "i")


@query("SELECT count(*) AS n FROM (SELECT * FROM documents LIMIT 200)")
def sample_by_hash(spark, sf):
    return sample_rows(load(spark, sf, "documents"), 200, "doc_id", 7).agg(F.count("*").alias("n"))


@query("SELECT sum((CAST('0x' || substr(md5(doc_id::VARCHAR), 1, 8) AS BIGINT) / 4294967296.0 < 0.2)::INT)::BIGINT AS held_out, count(*) AS n FROM documents")
def md5_split(spark, sf):
    return load(spark, sf, "documents").agg(F.sum((E.md5_uniform("doc_id") < 0.2).cast("long")).alias("held_out"), F.count("*").alias("n"))


@query()
def crc_split(spark, sf):
    """Held-out ids by crc32, which DuckDB does not have; checked against zlib in the tests."""
    return load(spark, sf, "documents").select("doc_id", E.crc_split("doc_id").alias("held_out"))


@query("WITH " + RECORDS_SQL + " SELECT country, count(*) AS n, count(DISTINCT name) AS names, sum((name = '')::INT)::BIGINT AS blank FROM rec GROUP BY country")
def record_view(spark, sf):
    return records(spark, sf).groupBy("country").agg(F.count("*").alias("n"), F.countDistinct("name").alias("names"), F.sum((F.col("name") == "").cast("long")).alias("blank"))


@query("WITH " + RECORDS_SQL + " SELECT s1.country, (SELECT count(*) FROM s23 WHERE s23.country = s1.country) AS n23, count(*) AS n1 FROM s1 GROUP BY s1.country")
def source_sizes(spark, sf):
    s1, s23 = sides(spark, sf)
    return s1.groupBy("country").agg(F.count("*").alias("n1")).join(s23.groupBy("country").agg(F.count("*").alias("n23")), "country", "left").select("country", F.coalesce("n23", F.lit(0)).alias("n23"), "n1")

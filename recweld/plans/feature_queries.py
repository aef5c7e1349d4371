"""Text normalisation and pair features over the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..functions.addresses import with_addresses
from ..functions.fuzzy import prefix_similarity, similarity_columns, suffix_similarity
from ..functions.names import skeleton, with_names
from ..functions.tables import HONORIFICS, LEGAL_FORMS, SKELETON
from ..operators import blocking as B
from ..operators import features as X
from .base import PAIRS_SQL, RECORDS_SQL, load, query, records, scored_pairs, sides

# part names with an addition each, so that the rules have something to do; all words are plain
_SUFFIXES = ["Ltd", "private limited", "(ID: 12345)", "| tail text", "& Sons", "d/b/a Other Name", "Inc.", ""]
_NAMED_SQL = "named AS (SELECT p_partkey AS id, p_name || ' ' || CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_SUFFIXES)) + " END AS raw, p_partkey % 8 AS kind FROM part)"
_PLAIN = "trim(regexp_replace(regexp_replace(regexp_replace(replace(CASE WHEN lower(raw) LIKE '% d/b/a %' THEN split_part(lower(raw), ' d/b/a ', 2) ELSE lower(raw) END, '&', ' and '), '\\s\\|\\s.*$', ' ', 'g'), '\\(\\s*id\\s*[:#]?\\s*\\d+\\s*\\)', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"
_DROPPED = ", ".join(f"'{w}'" for w in sorted({w for k, v in LEGAL_FORMS.items() for w in (k, *v)} | set(HONORIFICS)))
_FORMS = " ".join(f"WHEN '{v}' THEN '{k}'" for k, own in LEGAL_FORMS.items() for v in own)


def _named(spark, sf):
    suffix = F.element_at(F.array(*map(F.lit, _SUFFIXES)), (F.col("p_partkey") % 8 + 1).cast("int"))
    return load(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", suffix).alias("raw"))


@query(f"""WITH {_NAMED_SQL}, w AS (SELECT id, string_split({_PLAIN}, ' ') AS w FROM named),
x AS (SELECT id, i, w[i] AS t FROM w, range(1, 20) r(i) WHERE i <= len(w) AND w[i] <> ''),
f AS (SELECT id, i, CASE t {_FORMS} ELSE t END AS t, t IN ({_DROPPED}) AS gone, t NOT IN ({_DROPPED}) OR t IN ({", ".join(f"'{h}'" for h in HONORIFICS)}) AS plain FROM x),
d AS (SELECT *, lag(t) OVER (PARTITION BY id ORDER BY i) AS before FROM f), c AS (SELECT *, lag(t) OVER (PARTITION BY id ORDER BY i) AS cb FROM f WHERE NOT gone)
SELECT id, (SELECT string_agg(t, ' ' ORDER BY i) FROM d WHERE d.id = w.id AND (before IS NULL OR before <> t)) AS full_name, (SELECT string_agg(t, ' ' ORDER BY i) FROM c WHERE c.id = w.id AND (cb IS NULL OR cb <> t)) AS core,
 coalesce((SELECT string_agg(DISTINCT t, ' ' ORDER BY t) FROM f WHERE f.id = w.id AND NOT plain), '') AS legal FROM w""")
def norm_name_core(spark, sf):
    names = with_names(_named(spark, sf), "raw", F.lit(""))
    return names.select("id", F.col("name_full").alias("full_name"), F.col("name_core").alias("core"), F.col("name_legal").alias("legal"))


def skeleton_sql(c: str) -> str:
    """skeleton() of a word, in SQL."""
    sound = _skeleton_sql(c)
    return f"CASE WHEN regexp_full_match({c}, '[0-9]+') THEN {c} ELSE " + _shortened(f"substr({sound}, 1, 1) || regexp_replace(substr({sound}, 2), '[aeiouh]', '', 'g')") + " END"


def _skeleton_sql(c: str) -> str:
    for old, new in SKELETON:
        c = f"replace({c}, '{old}', '{new}')"
    return c


#: DuckDB's patterns have no back references: a run of one letter is shortened letter by letter.
_ONCE = "regexp_replace({}, '{}+', '{}', 'g')"


def _shortened(c: str) -> str:
    for letter in "abcdefghijklmnopqrstuvwxyz0123456789":
        c = _ONCE.format(c, letter, letter)
    return c


_SOUND = "substr(s, 1, 1) || regexp_replace(substr(s, 2), '[aeiouh]', '', 'g')"


@query(
    "WITH " + RECORDS_SQL + ", t AS (SELECT DISTINCT unnest(string_split(name, ' ')) AS token FROM rec), s AS (SELECT token, " + _skeleton_sql("token") + " AS s FROM t WHERE token <> '' AND NOT regexp_full_match(token, '[0-9]+'))"
    " SELECT token, " + _shortened(_SOUND) + " AS skel FROM s"
)
def phonetic_skeleton(spark, sf):
    tokens = records(spark, sf).select(F.explode(F.split("name", " ")).alias("token")).where("token <> '' and not token rlike '^[0-9]+$'").distinct()
    return tokens.select("token", skeleton(F.col("token")).alias("skel"))


_ADDRESS_SQL = "a AS (SELECT p_partkey AS id, p_size::VARCHAR || ' ' || lower(split_part(p_name, ' ', 1)) || ' street' AS street, replace(lower(p_brand), '#', ' ') AS place, CASE p_partkey % 3 WHEN 0 THEN 'Texas' WHEN 1 THEN 'CA' ELSE '' END AS region FROM part)"


@query(f"WITH {_ADDRESS_SQL} SELECT id, regexp_replace(split_part(street, ' ', 2), '[^a-z0-9]+', ' ', 'g') || ' st' AS street, split_part(street, ' ', 1) AS hnum, CASE region WHEN 'Texas' THEN 'tx' WHEN 'CA' THEN 'ca' ELSE '' END AS region FROM a")
def norm_address_parts(spark, sf):
    state = F.when(F.col("p_partkey") % 3 == 0, "Texas").when(F.col("p_partkey") % 3 == 1, "CA").otherwise("")
    raw = F.concat_ws(", ", F.concat_ws(" ", F.col("p_size").cast("string"), F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit("Street")), state)
    a = with_addresses(load(spark, sf, "part").select(F.col("p_partkey").alias("id"), raw.alias("raw")), "raw")
    return a.select("id", F.col("addr_street").alias("street"), F.col("addr_hnum").alias("hnum"), F.col("addr_region").alias("region"))


@query("WITH " + PAIRS_SQL + """, names AS (SELECT s1 AS id, name FROM s1 UNION ALL SELECT s23, name FROM s23), t AS (SELECT DISTINCT id, unnest(string_split(name, ' ')) AS term FROM names), u AS (SELECT * FROM t WHERE term <> ''),
n AS (SELECT count(DISTINCT id) AS n FROM u), w AS (SELECT term, ln((1.0 + max(n)) / (1.0 + count(*))) + 1 AS w FROM u, n GROUP BY term), v AS (SELECT id, term, w FROM u JOIN w USING (term)), tot AS (SELECT id, sum(w) AS t FROM v GROUP BY id),
i AS (SELECT p.s1, p.s23, sum(a.w) AS i FROM pairs p JOIN v a ON a.id = p.s1 JOIN v b ON b.id = p.s23 AND b.term = a.term GROUP BY 1, 2)
SELECT p.s1, p.s23, round(i / (a.t + b.t - i), 6) AS jacc, round(i / a.t, 6) AS cov1, round(i / b.t, 6) AS cov23 FROM pairs p JOIN i USING (s1, s23) JOIN tot a ON a.id = p.s1 JOIN tot b ON b.id = p.s23""")
def idf_overlap(spark, sf):
    s1, s23 = sides(spark, sf)
    term = lambda df, c: df.select(F.col(c).alias("id"), F.explode(E.words("name")).alias("term"))
    a, b = term(s1, "s1"), term(s23, "s23")
    out = X.idf_overlap(scored_pairs(spark, sf), a, b, B.idf(a.unionByName(b)))
    return out.select("s1", "s23", *[F.round(c, 6).alias(c) for c in ("jacc", "cov1", "cov23")])


@query("SELECT p_partkey AS partkey, count(*) OVER (PARTITION BY p_brand, p_name) AS freq FROM part")
def name_freq(spark, sf):
    p = load(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("country"), F.col("p_name").alias("name_core"))
    return p.join(X.name_frequency(p), ["country", "name_core"]).select(F.col("p_partkey").alias("partkey"), "freq")


@query("WITH " + PAIRS_SQL + """, w AS (SELECT s1, s23, list_distinct(list_filter(string_split(name1, ' '), lambda x: x <> '')) AS a, list_distinct(list_filter(string_split(name2, ' '), lambda x: x <> '')) AS b FROM pairs)
SELECT s1, s23, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jacc, (len(list_intersect(a, b)) > 0)::INT AS any_shared FROM w""")
def set_jaccard(spark, sf):
    a, b = E.words("name1"), E.words("name2")
    return scored_pairs(spark, sf).select("s1", "s23", F.round(E.jaccard(a, b), 6).alias("jacc"), F.arrays_overlap(a, b).cast("int").alias("any_shared"))


@query("""WITH p AS (SELECT a.p_partkey AS a, b.p_partkey AS b, a.p_size::VARCHAR AS h1, b.p_size::VARCHAR AS h2 FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_name = b.p_name AND a.p_partkey < b.p_partkey)
SELECT a, b, (h1 = h2)::INT AS eq, (starts_with(h1, h2) OR starts_with(h2, h1))::INT AS prefix, (h1 = h2)::INT AS contains, round(ln(1 + abs(h1::DOUBLE - h2::DOUBLE)), 6) AS logdiff FROM p""")
def house_number_match(spark, sf):
    """Dealt by number to all cores: the table is small in bytes, its pairs are not."""
    p = load(spark, sf, "part").select("p_brand", "p_name", F.col("p_partkey").alias("a"), F.col("p_size").cast("string").alias("h1"))
    p = p.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_brand", "p_name").withColumn("w1", E.words("h1"))
    pairs = p.join(p.withColumnsRenamed({"a": "b", "h1": "h2", "w1": "w2"}), ["p_brand", "p_name"]).where("a < b")
    h = X.house_numbers_of_words("h1", "h2", "w1", "w2")
    return pairs.select("a", "b", h["h_eq"].cast("int").alias("eq"), h["h_prefix"].cast("int").alias("prefix"), h["h_contains"].cast("int").alias("contains"), F.round(h["h_logdiff"], 6).alias("logdiff"))


@query("WITH " + PAIRS_SQL + " SELECT s1, s23, round(jaro_winkler_similarity(name1, name2), 6) AS jw FROM pairs")
def pair_jaro_winkler(spark, sf):
    f = similarity_columns({"jw": ("jaro_winkler", "name1", "name2")})
    return scored_pairs(spark, sf).select("s1", "s23", f.alias("f")).select("s1", "s23", F.round("f.jw", 6).alias("jw"))


@query("WITH " + PAIRS_SQL + """, x AS (SELECT *, greatest(length(name1), length(name2)) AS n FROM pairs),
m AS (SELECT *, (SELECT count(*) FROM range(1, 42) r(k) WHERE k <= length(name1) AND k <= length(name2) AND substr(name1, 1, k) = substr(name2, 1, k)) AS p, (SELECT count(*) FROM range(1, 42) r(k) WHERE k <= length(name1) AND k <= length(name2) AND right(name1, k) = right(name2, k)) AS q FROM x)
SELECT s1, s23, round(p / n, 6) AS pre, round(q / n, 6) AS suf FROM m""")
def pair_prefix_suffix(spark, sf):
    pre, suf = (f("name1", "name2") for f in (prefix_similarity, suffix_similarity))
    return scored_pairs(spark, sf).select("s1", "s23", F.round(pre, 6).alias("pre"), F.round(suf, 6).alias("suf"))


@query()
def pair_fuzzy_scores(spark, sf):
    """Subsequence ratios, which no SQL function has; checked against their definitions in the tests."""
    wanted = {m: (m, "name1", "name2") for m in ("ratio", "token_sort_ratio", "token_set_ratio", "partial_ratio")}
    return scored_pairs(spark, sf).select("s1", "s23", similarity_columns(wanted).alias("f")).select("s1", "s23", "f.*")


@query("WITH " + PAIRS_SQL + """, x AS (SELECT s1, s23, score AS nm, CASE WHEN src = 2 THEN NULL ELSE round(length(name1) / (length(name1) + length(name2)), 6) END AS ad, (length(name1) = length(name2))::INT::DOUBLE AS h FROM pairs)
SELECT s1, s23, round(nm * ad, 6) AS ix_name_x_addr, round(CASE WHEN ad IS NOT NULL THEN least(nm, ad) END, 6) AS ix_min_name_addr, round(nm * h, 6) AS ix_name_x_hnum, round(nm - ad, 6) AS ix_name_minus_addr,
 round(0.55 * nm + 0.45 * CASE WHEN ad IS NULL THEN 0.5 ELSE 0.5 * ad + 0.5 * h END, 6) AS raw_score FROM x""")
def pair_interactions(spark, sf):
    n1, n2 = F.length("name1"), F.length("name2")
    p = scored_pairs(spark, sf).withColumns({"ad": F.when(F.col("src") != 2, F.round(n1 / (n1 + n2), 6)), "h": (n1 == n2).cast("double")})
    made = X.interactions(F.col("score"), F.col("ad"), F.col("h"), F.col("ad").isNull())
    return p.select("s1", "s23", *[F.round(v, 6).alias(k) for k, v in made.items()])


def _competition_sql(by: str, tie: str, p: str) -> str:
    return f"""{p}a AS (SELECT s1, s23, score, rank() OVER (PARTITION BY {by} ORDER BY score DESC) AS r, count(*) OVER (PARTITION BY {by}) AS n, sum((score = 1)::INT) OVER (PARTITION BY {by})::BIGINT AS e, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, {tie}) AS rn, max(score) OVER (PARTITION BY {by}) AS t1 FROM pairs),
{p} AS (SELECT s1, s23, r AS {p}_rank, n AS {p}_n, e AS {p}_n_exactname, round(CASE WHEN score >= t1 THEN score - CASE WHEN n > 1 THEN max(CASE WHEN rn = 2 THEN score END) OVER (PARTITION BY {by}) ELSE 0 END ELSE score - t1 END, 6) AS {p}_margin FROM {p}a)"""


@query("WITH " + PAIRS_SQL + ", " + _competition_sql("s1", "s23", "c1") + ", " + _competition_sql("s23", "s1", "c23") + " SELECT * FROM c1 JOIN c23 USING (s1, s23)")
def competition_features(spark, sf):
    p = scored_pairs(spark, sf).select("s1", "s23", F.col("score").alias("raw_score"), (F.col("score") == 1).cast("long").alias("n_exact_core"))
    out = X.competition_features(p)
    return out.select("s1", "s23", *[F.round(c, 6).alias(c) if c.endswith("margin") else F.col(c) for c in X.COMPETITION_FEATURES])


@query()
def pair_features(spark, sf):
    """All 69 features of pairs by shared keys and nearest vectors of parts read as records."""
    from .linkage import features_of_parts

    return features_of_parts(spark, sf)


@query("WITH " + PAIRS_SQL + ", f AS (SELECT *, count(*) OVER (PARTITION BY name1) AS n FROM pairs) SELECT name1, max(n) AS n, rank() OVER (ORDER BY max(n) DESC, name1) AS place FROM f GROUP BY name1 QUALIFY place <= 20")
def name_trap_ranking(spark, sf):
    n = scored_pairs(spark, sf).groupBy("name1").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "name1").limit(20).withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "name1")).cast("long"))

"""Features of candidate pairs: 61 of a pair by itself, and 8 of its standing among its rivals.

All but the similarities of strings are native expressions; the similarities are one Arrow pass over the pairs. A value
that cannot be told (a blank side) is NULL, never 0. Inputs: pairs (s1, s23, n_keys, cos, rank_fwd, rank_rev), and
normalised records on both sides with an id column entity_id.
"""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import jaccard, strict_greatest, strict_least, words
from ..functions.fuzzy import GRAMS, gram_code, prefix_similarity, similarity_columns, suffix_similarity
from .blocking import char_grams, idf
from .selection import with_rank_margin

TEXT_COLUMNS = ["country", "name_full", "name_core", "name_legal", "name_alias", "name_skel", "name_nospace", "name_is_domain", "addr_norm", "addr_street", "addr_locality", "addr_region", "addr_nums", "addr_hnum", "addr_landmark", "addr_blank"]
#: Used for ranks a pair does not have.
NO_RANK = 99
EXACT_NAME = 100.0


def name_frequency(records: DataFrame, by: tuple[str, ...] = ("country", "name_core")) -> DataFrame:
    """How many records of a side have each name in each country."""
    return records.groupBy(*by).agg(F.count("*").alias("freq"))


def idf_overlap(pairs: DataFrame, left: DataFrame, right: DataFrame, weights: DataFrame) -> DataFrame:
    """(s1, s23, jacc, cov1, cov23) by idf of distinct words, from (id, term) of both sides; a word without idf weighs 1.
    NULL where the divisor is 0."""
    w = weights.select("term", "idf")
    a = left.select(F.col("id").alias("s1"), "term").distinct().join(w, "term", "left").select("s1", "term", F.coalesce("idf", F.lit(1.0)).alias("w"))
    b = right.select(F.col("id").alias("s23"), "term").distinct().join(w, "term", "left").select("s23", "term", F.coalesce("idf", F.lit(1.0)).alias("w"))
    ta, tb = a.groupBy("s1").agg(F.sum("w").alias("t1")), b.groupBy("s23").agg(F.sum("w").alias("t2"))
    shared = pairs.select("s1", "s23").join(a, "s1").join(b.drop("w"), ["s23", "term"]).groupBy("s1", "s23").agg(F.sum("w").alias("i"))
    out = pairs.select("s1", "s23").join(shared, ["s1", "s23"], "left").join(ta, "s1", "left").join(tb, "s23", "left")
    i, t1, t2 = (F.coalesce(c, F.lit(0.0)) for c in ("i", "t1", "t2"))
    return out.select("s1", "s23", F.try_divide(i, t1 + t2 - i).alias("jacc"), F.try_divide(i, t1).alias("cov1"), F.try_divide(i, t2).alias("cov23"))


def house_numbers(h1: str, h2: str, nums1: str, nums2: str) -> dict[str, Column]:
    """Equality, prefix, containment and distance of house numbers; NULL unless both are there."""
    return house_numbers_of_words(h1, h2, words(nums1), words(nums2))


def house_numbers_of_words(h1: str, h2: str, nums1: str | Column, nums2: str | Column) -> dict[str, Column]:
    """As house_numbers(), from arrays of all numbers: where a record has many pairs, they are made once per record."""
    a, b = F.col(h1), F.col(h2)
    both = (a != "") & (b != "")
    number = lambda c: F.expr(f"try_cast(substr({c}, 1, 9) as double)")
    flag = lambda cond: F.when(both, cond.cast("double"))
    return {
        "h_both": both.cast("double"),
        "h_eq": flag(a == b),
        "h_prefix": flag(F.startswith(a, b) | F.startswith(b, a)),
        "h_contains": flag(F.array_contains(nums1, b) | F.array_contains(nums2, a)),
        "h_logdiff": F.when(both, F.log1p(F.abs(number(h1) - number(h2)))),
    }


def interactions(name: Column, addr: Column, h_eq: Column, any_blank: Column) -> dict[str, Column]:
    """Products and differences of name and address similarity (0 to 1), and the raw score."""
    known = lambda c: F.coalesce(c, F.lit(0.0))
    return {
        "ix_name_x_addr": name * addr,
        "ix_min_name_addr": strict_least(name, addr),
        "ix_name_x_hnum": name * h_eq,
        "ix_name_minus_addr": name - addr,
        "raw_score": 0.55 * known(name) + 0.45 * F.when(any_blank, F.lit(0.5)).otherwise(0.5 * known(addr) + 0.5 * known(h_eq)),
    }


def gram_table(records: DataFrame, text: Column) -> Broadcast:
    """Weights of all grams of three characters, by their frequency among records: GRAMS numbers, whatever the input."""
    counts = records.select(F.explode(F.array_distinct(char_grams(text))).alias("gram")).groupBy("gram").agg(F.count("*").alias("df")).collect()
    n = records.where(F.size(char_grams(text)) > 0).count()
    df = np.zeros(GRAMS)
    for r in counts:
        df[gram_code(r["gram"])] += r["df"]
    return records.sparkSession.sparkContext.broadcast(np.log((1 + n) / (1 + df)) + 1)


def weighted_words(records: DataFrame, column: str, numbers: bool) -> DataFrame:
    """(id, words): each record's distinct words with their idf, as an array; words and their counts meet once per record."""
    own = words(column) if numbers else F.filter(words(column), lambda w: ~F.rlike(w, F.lit("^[0-9]+$")))
    terms = records.select(F.col("entity_id").alias("id"), F.explode(own).alias("term"))
    return terms.join(idf(terms).select("term", "idf"), "term").groupBy("id").agg(F.collect_list(F.struct(F.col("term").alias("word"), F.col("idf").alias("idf"))).alias("words"))


def overlap(a: str, b: str, prefix: str) -> dict[str, Column]:
    """Jaccard similarity and coverage of either side by idf, from two arrays of weighted words."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda t, w: t + w["idf"])
    x, y = (F.coalesce(c, F.array().cast("array<struct<word:string,idf:double>>")) for c in (a, b))
    i = total(F.filter(x, lambda w: F.array_contains(F.transform(y, lambda v: v["word"]), w["word"])))
    return {f"{prefix}_idf_jacc": F.try_divide(i, total(x) + total(y) - i), f"{prefix}_idf_cov1": F.try_divide(i, total(x)), f"{prefix}_idf_cov23": F.try_divide(i, total(y))}


_ADDRESS_TEXT = "trim(concat(addr_street, ' ', replace(addr_locality, '|', ' ')))"


def described_records(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with what a record brings into all of its pairs: weighted words of name and address, how many records of
    its side have its name, and derived texts."""
    every = left.unionByName(right, allowMissingColumns=True)
    extra = None
    for column, name, numbers in (("name_core", "name_words", True), ("addr_norm", "addr_words", False)):
        w = weighted_words(every, column, numbers).withColumnRenamed("words", name)
        extra = w if extra is None else extra.join(w, "id", "full")
    out = []
    for side in (left, right):
        freq = name_frequency(side).withColumn("freq", F.col("freq").cast("double"))
        texts = {"loc_words": F.replace("addr_locality", F.lit("|"), F.lit(" ")), "addr_text": F.expr(_ADDRESS_TEXT)}
        out.append(side.withColumns(texts).join(extra.withColumnRenamed("id", "entity_id"), "entity_id", "left").join(freq, ["country", "name_core"], "left"))
    return out[0], out[1]


RECORD_COLUMNS = [*TEXT_COLUMNS, "loc_words", "addr_text", "name_words", "addr_words", "freq"]


def pair_features(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """The 61 features of each pair.

    Weights and counts are worked out per record; a pair then needs its two records only: one join with the right-hand
    side, one with the left-hand side, which leaves all pairs of a left-hand record in one part. The similarities of strings
    are one Arrow pass, all other features native expressions.
    """
    every = left.unionByName(right, allowMissingColumns=True)
    grams = {"n_char_cos": ("name_core_1", "name_core_2", gram_table(every, F.col("name_core"))), "a_char_cos": ("addr_text_1", "addr_text_2", gram_table(every, F.expr(_ADDRESS_TEXT)))}
    left, right = described_records(left, right)
    side = lambda df, key, k: df.select(F.col("entity_id").alias(key), *[F.col(c).alias(f"{c}_{k}") for c in RECORD_COLUMNS])
    # by number: adaptive execution joins partitions by their bytes, and here rows cost time, not bytes
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p = pairs.join(side(right, "s23", 2), "s23").repartition(parts, "s1").join(side(left, "s1", 1), "s1")
    similar = {
        "n_tsort": ("token_sort_ratio", "name_core_1", "name_core_2"), "n_tset": ("token_set_ratio", "name_core_1", "name_core_2"), "n_partial": ("partial_ratio", "name_core_1", "name_core_2"), "n_ratio": ("ratio", "name_core_1", "name_core_2"),
        "n_full_tset": ("token_set_ratio", "name_full_1", "name_full_2"), "n_skel_ratio": ("ratio", "name_skel_1", "name_skel_2"), "n_skel_tset": ("token_set_ratio", "name_skel_1", "name_skel_2"),
        "n_nospace_jw": ("jaro_winkler", "name_nospace_1", "name_nospace_2"), "n_alias_tset": ("token_set_ratio", "name_core_1", "name_alias_2"), "a_tset": ("token_set_ratio", "addr_norm_1", "addr_norm_2"),
        "a_tsort": ("token_sort_ratio", "addr_norm_1", "addr_norm_2"), "a_ratio": ("ratio", "addr_norm_1", "addr_norm_2"), "a_street_tset": ("token_set_ratio", "addr_street_1", "addr_street_2"), "loc_tset": ("token_set_ratio", "loc_words_1", "loc_words_2"),
    }
    p = p.withColumn("_f", similarity_columns(similar, grams)).select("*", *[F.col(f"_f.{c}").alias(c) for c in (*similar, *grams)]).drop("_f")
    blank = F.col("addr_blank_1") | F.col("addr_blank_2")
    both = lambda c: (F.col(f"{c}_1") != "") & (F.col(f"{c}_2") != "")
    same = lambda c: (F.col(f"{c}_1") == F.col(f"{c}_2")).cast("double")
    loc = [F.filter(F.split(f"addr_locality_{k}", r"[|]"), lambda x: x != "") for k in (1, 2)]
    nums = [words(f"addr_nums_{k}") for k in (1, 2)]
    made = {c: F.when(~blank, F.col(c)) for c in ("a_tset", "a_tsort", "a_ratio", "a_street_tset", "a_char_cos")}
    made |= {"n_prefix": prefix_similarity("name_nospace_1", "name_nospace_2"), "n_suffix": suffix_similarity("name_nospace_1", "name_nospace_2")}
    made |= {"loc_tset": F.when(both("addr_locality"), F.col("loc_tset")), "n_alias_tset": F.when(F.col("name_alias_2") != "", F.col("n_alias_tset"))}
    made |= {f"n_exact_{k}": same(f"name_{k}") for k in ("core", "full", "skel", "nospace")}
    made |= {"legal_eq": F.when(both("name_legal"), same("name_legal")), "region_eq": F.when(both("addr_region"), same("addr_region"))}
    made |= {f"n_len{k}": F.length(f"name_core_{k}").cast("double") for k in (1, 2)} | {f"n_ntok{k}": (F.regexp_count(f"name_core_{k}", F.lit(" ")) + 1).cast("double") for k in (1, 2)}
    made |= {"n_has_alias2": (F.col("name_alias_2") != "").cast("double"), "n_is_domain2": F.col("name_is_domain_2").cast("double"), "name_freq_s1": F.col("freq_1"), "name_freq_s23": F.col("freq_2")}
    made |= {"a_blank1": F.col("addr_blank_1").cast("double"), "a_blank2": F.col("addr_blank_2").cast("double"), "a_blank_any": blank.cast("double")}
    made |= {"loc_jacc": jaccard(*loc), "loc_any": F.when(F.size(F.array_union(*loc)) > 0, F.arrays_overlap(*loc).cast("double"))}
    made |= house_numbers("addr_hnum_1", "addr_hnum_2", "addr_nums_1", "addr_nums_2")
    made |= {"nums_jacc": F.when((F.size(nums[0]) > 0) & (F.size(nums[1]) > 0), jaccard(*nums)), "landmark_any": ((F.col("addr_landmark_1") != "") | (F.col("addr_landmark_2") != "")).cast("double")}
    made |= {"country_match": same("country"), "src_s3": F.startswith(F.col("s23").cast("string"), F.lit("S3-")).cast("double")}
    made |= {"b_cos": F.coalesce("cos", F.lit(0.0)), "b_rank_fwd": F.coalesce("rank_fwd", F.lit(NO_RANK)).cast("double"), "b_rank_rev": F.coalesce("rank_rev", F.lit(NO_RANK)).cast("double"), "b_n_keys": F.coalesce("n_keys", F.lit(0)).cast("double")}
    made |= overlap("name_words_1", "name_words_2", "n") | {k: F.when(~blank, c) for k, c in overlap("addr_words_1", "addr_words_2", "a").items()}
    p = p.withColumns(made)
    name, addr = strict_greatest("n_tset", "n_skel_tset") / 100, F.col("a_tset") / 100
    return p.withColumns(interactions(name, addr, F.col("h_eq"), blank)).select("s1", "s23", *PAIR_FEATURES)


PAIR_FEATURES = (
    "n_tsort n_tset n_partial n_ratio n_full_tset n_skel_ratio n_skel_tset n_nospace_jw n_prefix n_suffix n_alias_tset n_char_cos n_idf_jacc n_idf_cov1 n_idf_cov23 n_exact_core n_exact_full n_exact_skel n_exact_nospace legal_eq "
    "n_len1 n_len2 n_ntok1 n_ntok2 n_has_alias2 n_is_domain2 name_freq_s1 name_freq_s23 a_blank1 a_blank2 a_blank_any a_tset a_tsort a_ratio a_street_tset a_char_cos a_idf_jacc a_idf_cov1 a_idf_cov23 loc_jacc loc_any loc_tset region_eq "
    "h_both h_eq h_prefix h_contains h_logdiff nums_jacc landmark_any ix_name_x_addr ix_min_name_addr ix_name_x_hnum ix_name_minus_addr country_match src_s3 b_cos b_rank_fwd b_rank_rev b_n_keys raw_score"
).split()
COMPETITION_FEATURES = [f"{p}_{c}" for p in ("c1", "c23") for c in ("rank", "n", "n_exactname", "margin")]


def competition_features(pairs: DataFrame, score: str = "raw_score", exact: str = "n_exact_core") -> DataFrame:
    """Rank, size, exact names and margin of a pair among the pairs of its record, on either side."""
    for prefix, by, tie in (("c1_", "s1", "s23"), ("c23_", "s23", "s1")):
        pairs = with_rank_margin(pairs, by, score, tie, prefix).withColumn(f"{prefix}n_exactname", F.sum(F.col(exact)).over(Window.partitionBy(by)))
    return pairs

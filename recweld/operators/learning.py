"""What is learned from data: places of regions, aliases of places, samples, boosted trees, stacked scores."""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import strict_least, uniform
from ..functions.fuzzy import similarity_columns
from .selection import sum_of_others, top_k

REGION_COUNT, REGION_PURITY = 3, 0.9
ALIAS_COUNT, ALIAS_PURITY, ALIAS_TOGETHER = 50, 0.6, 0.05
ANCHOR_SCORE, ANCHORS = 0.9, 4
#: Stands for an undefined feature in vectors: below all scores and margins.
MISSING = -9.0
#: Rows that a counted row is dealt to, at most; models fitted side by side, at most.
PARTS, TOGETHER = 32, 5


def region_map(places: DataFrame, min_count: int = REGION_COUNT, purity: float = REGION_PURITY) -> DataFrame:
    """(country, loc, region) rows -> (country, loc, imp_region, n): places seen often enough, nearly always in one region."""
    n = places.where("loc <> '' and region <> ''").groupBy("country", "loc", "region").agg(F.count("*").alias("n"))
    n = n.withColumn("total", F.sum("n").over(Window.partitionBy("country", "loc")))
    kept = n.where((F.col("total") >= min_count) & (F.col("n") >= purity * F.col("total")))
    return kept.select("country", "loc", F.col("region").alias("imp_region"), "n")


def impute_regions(records: DataFrame, regions: DataFrame) -> DataFrame:
    """Fills an empty addr_region of an address that is not blank from its localities (the array locs): the place seen most
    often wins, then the smaller region and place."""
    hits = records.where("addr_region = '' and not addr_blank").select("entity_id", "country", F.explode("locs").alias("loc")).join(regions, ["country", "loc"])
    best = top_k(hits, "entity_id", [F.desc("n"), "imp_region", "loc"], 1).select("entity_id", "imp_region")
    out = records.join(best, "entity_id", "left")
    return out.withColumn("addr_region", F.coalesce("imp_region", "addr_region")).drop("imp_region")


def ordered_pair_counts(rows: DataFrame, by: list[str], key: str, value: str) -> DataFrame:
    """(a, b, n): how many pairs of rows of one group have the values a and b, the row of a having the smaller key.

    Pairs are counted, not made. Of two places in a group's order, the smaller has 0 and the greater 1 in the first bit that
    differs; so per bit and the bits before it, the counts of values with 0 are multiplied by those with 1.
    """
    group = Window.partitionBy(*by)
    placed = rows.dropna(subset=[*by, key]).withColumn("_k", F.dense_rank().over(group.orderBy(key)).cast("long") - 1)
    placed = placed.withColumn("_most", F.max("_k").over(group)).where("_most > 0")
    bits = placed.select(*by, value, "_k", F.explode(F.sequence(F.lit(0), F.length(F.bin("_most")) - 1)).alias("_bit"))
    above = F.expr("shiftright(_k, _bit + 1)").alias("_above")
    counts = bits.groupBy(*by, "_bit", above, value).agg(*[F.count_if(F.expr(f"shiftright(_k, _bit) % 2 = {x}")).alias(f"_n{x}") for x in (0, 1)])
    left, right = (counts.where(f"_n{x} > 0").select(*by, "_bit", "_above", F.col(value).alias(name), f"_n{x}") for x, name in ((0, "a"), (1, "b")))
    return left.join(right, [*by, "_bit", "_above"]).groupBy("a", "b").agg(F.sum(F.col("_n0") * F.col("_n1")).alias("n"))


def mine_aliases(pairs: DataFrame, parts: DataFrame, min_count: int = ALIAS_COUNT, purity: float = ALIAS_PURITY, together: float = ALIAS_TOGETHER) -> DataFrame:
    """(variant, canonical, n): parts of right-hand records that stand where true partners have another part.

    pairs: (s1, s23, a, b) with the arrays of parts of both sides, or (a, b, n) with the number of such pairs. parts: (id, part)
    of all records. Kept are pairs of parts that are left over together at least min_count times and in a share purity of the
    variant's cases, unless one record has both in more than a share of `together`.
    """
    times = F.col("n") if "n" in pairs.columns else F.lit(1)
    left = pairs.select(F.array_except("a", "b").alias("x"), F.array_except("b", "a").alias("y"), times.cast("long").alias("n")).where("size(x) = 1 or size(y) = 1")
    n = left.select(F.explode("y").alias("variant"), "x", "n").select("variant", F.explode("x").alias("canonical"), "n").groupBy("variant", "canonical").agg(F.sum("n").alias("n"))
    n = n.withColumn("total", F.sum("n").over(Window.partitionBy("variant"))).where((F.col("n") >= min_count) & (F.col("n") >= purity * F.col("total")))
    own = parts.distinct()
    sizes = own.groupBy("part").agg(F.count("*").alias("size"))
    wanted = n.select("variant", "canonical")
    both = wanted.join(own.withColumnRenamed("part", "variant"), "variant").join(own.withColumnRenamed("part", "canonical"), ["id", "canonical"]).groupBy("variant", "canonical").agg(F.count("*").alias("both"))
    out = n.join(both, ["variant", "canonical"], "left").join(sizes.withColumnRenamed("part", "variant"), "variant", "left")
    return out.where(F.coalesce("both", F.lit(0)) <= together * F.coalesce("size", F.lit(1))).select("variant", "canonical", "n")


def stratum(label: Column, hard: list[tuple[str, Column]]) -> Column:
    """POS for true pairs, then the first of the hard kinds that holds, else E."""
    return reduce(lambda chain, kind: chain.when(kind[1], kind[0]), hard, F.when(label, "POS")).otherwise("E")


#: Most sampled rows of a kind (without one, all stay), and how much more its rows count (fixed values).
STRATA_CAPS = {"H2": 4_000_000, "H3": 3_000_000, "E": 3_000_000}
STRATA_BOOSTS = {"H1": 2.0, "H2": 1.5, "H3": 1.5}


def pair_stratum(label: Column) -> Column:
    """Hard kinds of pairs: one name without addresses (H1), like names at unlike addresses (H2), the first among their
    rivals (H3)."""
    name = F.greatest("n_tset", "n_skel_tset")
    known = lambda c: F.coalesce(c, F.lit(False))
    unlike = known(F.col("a_tset") < 70) | known(F.col("h_eq") == 0)
    return stratum(label, [("H1", (F.col("n_exact_core") == 1) & (F.col("a_blank_any") == 1)), ("H2", known(name >= 90) & (F.col("a_blank_any") == 0) & unlike), ("H3", (F.col("c1_rank") <= 3) | (F.col("c23_rank") <= 2))])


def stratified_sample(rows: DataFrame, strata: str, u: Column, caps: dict[str, int], boosts: dict[str, float] | None = None) -> DataFrame:
    """Rows with u below their stratum's rate, min(1, cap / count), and their weight, boost / rate. Strata without a cap stay
    whole. Strata are few: their counts are a small table. The same rows are taken however the data is partitioned."""
    boosts = boosts or {}
    rate = F.lit(1.0)
    boost = F.lit(1.0)
    for k, cap in caps.items():
        rate = F.when(F.col(strata) == k, F.least(F.lit(1.0), F.lit(float(cap)) / F.col("_n"))).otherwise(rate)
    for k, b in boosts.items():
        boost = F.when(F.col(strata) == k, F.lit(float(b))).otherwise(boost)
    rates = rows.groupBy(strata).agg(F.count("*").alias("_n")).withColumn("_rate", rate)
    return rows.join(F.broadcast(rates), strata).where(u < F.col("_rate")).withColumn("weight", boost / F.col("_rate")).drop("_n", "_rate")


def balanced(rows: DataFrame, label: str, weight: str = "weight") -> DataFrame:
    """Weights of positives times the ratio of the classes' weights, where both have rows."""
    sums = rows.agg(F.sum(F.when(F.col(label) == 0, F.col(weight))).alias("_neg"), F.sum(F.when(F.col(label) == 1, F.col(weight))).alias("_pos"))
    return rows.join(F.broadcast(sums)).withColumn(weight, F.when(F.col(label) == 1, F.col(weight) * F.coalesce(F.col("_neg") / F.col("_pos"), F.lit(1.0))).otherwise(F.col(weight))).drop("_neg", "_pos")


def dealt(rows: DataFrame, weight: str) -> DataFrame:
    """Rows that count weight times (1 and more), as up to PARTS rows of equal weight each: a round of trees that draws some of
    the rows then has about that share of each, as if it drew from those counted."""
    parts = F.least(F.col(weight), F.lit(PARTS)).cast("int")
    return rows.withColumn(weight, F.explode(F.array_repeat(F.col(weight) / parts, parts)))


def gbt(features: list[str], label: str = "y", weight: str | None = None, validation: str | None = None, rounds: int = 40, depth: int = 6, seed: int = 42, **more) -> Pipeline:
    """Boosted trees over the features; undefined values become MISSING."""
    model = GBTClassifier(featuresCol="_x", labelCol=label, maxIter=rounds, maxDepth=depth, seed=seed, **({"stepSize": 0.15, "subsamplingRate": 0.8} | more))
    if weight:
        model = model.setWeightCol(weight)
    if validation:
        model = model.setValidationIndicatorCol(validation)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x"), model])


def fitted(model: Pipeline, rows: DataFrame):
    """The model learned from the rows, None without rows."""
    return None if rows.isEmpty() else model.fit(rows)


def filled(rows: DataFrame, features: list[str]) -> DataFrame:
    return rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(MISSING)) for c in features})


def scored(model, rows: DataFrame, features: list[str], name: str = "p") -> DataFrame:
    """The rows with the probability of a match, as double; NULL without a model."""
    if model is None:
        return filled(rows, features).withColumn(name, F.lit(None).cast("double"))
    out = model.transform(filled(rows, features))
    return out.withColumn(name, vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction")


def importance(model, features: list[str]) -> list[tuple[str, float | None]]:
    """(feature, gain), the greatest first; NULL without a model."""
    if model is None:
        return [(f, None) for f in features]
    return sorted(zip(features, model.stages[-1].featureImportances.toArray().tolist(), strict=True), key=lambda x: -x[1])


def fold_of(key: str, seed: int = 11, folds: int = 2) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(folds)).cast("int")


def fold_models(train: DataFrame, features: list[str], label: str = "y", weight: str | None = None, by: str = "s1", rounds: int = 20) -> list:
    """For each of two folds of the records, the model of the other one, None if that has no rows."""
    data = filled(train, features).withColumn("_fold", fold_of(by))
    return [fitted(gbt(features, label, weight, rounds=rounds, depth=4), data.where(F.col("_fold") != k)) for k in (0, 1)]


def fold_scores(models: list, rows: DataFrame, features: list[str], unseen: Column, by: str = "s1", name: str = "p1") -> DataFrame:
    """Cross-fitted scores: a row that was learned from is scored by the model of the other fold, an unseen one by the mean.
    Without a model of the other fold a score is NULL, and with one model only, unseen rows have its score."""
    data = filled(rows, features).withColumn("_fold", fold_of(by))
    for k, m in enumerate(models):
        data = scored(m, data, features, f"_p{k}")
    own = F.when(F.col("_fold") == 0, F.col("_p0")).otherwise(F.col("_p1"))
    return data.withColumn(name, F.when(unseen, F.coalesce((F.col("_p0") + F.col("_p1")) / 2, "_p0", "_p1")).otherwise(own)).drop("_p0", "_p1", "_fold")


def out_of_fold(rows: DataFrame, features: list[str], label: str = "y", held_out: str = "is_val", by: str = "s1", rounds: int = 20, name: str = "p1") -> DataFrame:
    """Cross-fitted scores of labelled rows: held-out ones are unseen by both folds."""
    models = fold_models(rows.where(~F.col(held_out)), features, label, None, by, rounds)
    return fold_scores(models, rows, features, F.col(held_out), by, name)


def group_context(p: DataFrame, score: str = "p1", confident: float = ANCHOR_SCORE) -> DataFrame:
    """Standing of a pair among its record's pairs on both sides: rank, size, other confident pairs, the best of the others, and
    the lead over it; with a column src, the other confident pairs and all pairs of the record with the same source as well."""
    out = p.withColumn("_sure", (F.col(score) >= confident).cast("long"))
    for prefix, by, tie in (("c1", "s1", "s23"), ("c23", "s23", "s1")):
        part = Window.partitionBy(by)
        order = part.orderBy(F.desc(score), tie)
        out = out.withColumns({
            f"{prefix}_p_rank": F.rank().over(part.orderBy(F.desc(score))).cast("long"),
            f"{prefix}_p_n": F.count("*").over(part),
            f"{prefix}_sure_others": sum_of_others("_sure", by),
            f"{prefix}_p_other": F.when(F.row_number().over(order) == 1, F.lead(score).over(order)).otherwise(F.max(score).over(part)),
        })
        out = out.withColumn(f"{prefix}_p_margin", F.col(score) - F.coalesce(f"{prefix}_p_other", F.lit(0.0)))
    if "src" in p.columns:
        own = Window.partitionBy("s1", "src")
        out = out.withColumns({"c1_sure_same_source": F.sum("_sure").over(own) - F.col("_sure"), "c1_n_same_source": F.count("*").over(own)})
    return out.drop("_sure")


def anchors(p: DataFrame, score: str = "p1", confident: float = ANCHOR_SCORE, most: int = ANCHORS) -> DataFrame:
    """The most confident right-hand records of each left-hand one: (s1, anchor)."""
    return top_k(p.where(F.col(score) >= confident), "s1", [F.desc(score), "s23"], most).select("s1", F.col("s23").alias("anchor"))


def anchor_features(p: DataFrame, found: DataFrame, names: DataFrame) -> DataFrame:
    """The greatest similarity of a pair's record to the other anchors of its left-hand record; NULL without another.
    names: (id, name, skel, addr, hnum) of right-hand records."""
    side = lambda i, key: names.select(F.col("id").alias(key), *[F.col(c).alias(f"{c}_{i}") for c in ("name", "skel", "addr", "hnum")])
    j = p.select("s1", "s23").join(found, "s1").where("anchor <> s23").join(side(1, "s23"), "s23").join(side(2, "anchor"), "anchor")
    sims = similarity_columns({"anc_name": ("token_set_ratio", "name_1", "name_2"), "anc_skel": ("ratio", "skel_1", "skel_2"), "anc_addr": ("token_set_ratio", "addr_1", "addr_2")})
    both = lambda c: (F.col(f"{c}_1") != "") & (F.col(f"{c}_2") != "")
    j = j.withColumn("f", sims).select("s1", "s23", "f.anc_name", "f.anc_skel", F.when(both("addr"), F.col("f.anc_addr")).alias("anc_addr"), F.when(both("hnum"), (F.col("hnum_1") == F.col("hnum_2")).cast("double")).alias("anc_hnum"), (F.col("name_1") == F.col("name_2")).cast("double").alias("anc_exact_name"), F.when(both("addr"), (F.col("addr_1") == F.col("addr_2")).cast("double")).alias("anc_exact_addr"))
    j = j.withColumn("anc_both", strict_least("anc_name", "anc_addr"))
    cols = ("anc_name", "anc_skel", "anc_addr", "anc_both", "anc_hnum", "anc_exact_name", "anc_exact_addr")
    best = j.groupBy("s1", "s23").agg(*[F.max(c).alias(c) for c in cols], F.count("*").alias("anc_n"))
    return p.join(best, ["s1", "s23"], "left").withColumn("anc_n", F.coalesce("anc_n", F.lit(0)))


def _average_precisions(models: dict[str, tuple[Pipeline, DataFrame, list[str]]], test: DataFrame, label: str, weight: str | None) -> list[tuple[str, float | None]]:
    """(name, ap) of models (name -> model, training rows, features), fitted side by side: the jobs of a small table leave cores
    idle. NULL if there is nothing to learn from."""
    from .evaluation import average_precision

    def one(x: tuple[Pipeline, DataFrame, list[str]]) -> float | None:
        model = fitted(x[0], filled(x[1], x[2]))
        return model and average_precision(scored(model, test, x[2]), "p", label, weight).first()["ap"]

    with ThreadPool(TOGETHER) as pool:
        return list(zip(models, pool.map(inheritable_thread_target(test.sparkSession)(one), models.values()), strict=True))


def ablation(train: DataFrame, test: DataFrame, groups: dict[str, list[str]], label: str = "y", rounds: int = 40, depth: int = 6, share: float = 0.25, key: str = "s1", weight: str | None = None):
    """(subset, ap) of models fitted on each subset of features, on a share of the records chosen by a hash, or on all rows where
    the share is 1 (the key is not needed then). NULL if there is nothing to learn from. With a weight, rows count so many times."""
    own = train if share >= 1 else train.where(uniform(key, 3) < share)
    own = dealt(own, weight) if weight else own
    out = _average_precisions({name: (gbt(features, label, weight, rounds=rounds, depth=depth), own, features) for name, features in groups.items()}, test, label, weight)
    return train.sparkSession.createDataFrame(out, "subset string, ap double")


def sweep(train: DataFrame, test: DataFrame, features: list[str], settings: list[dict], label: str = "y", weight: str | None = None):
    """(setting, ap) of models fitted with each setting of depth, rounds and the like; NULL if there is nothing to learn from.
    With a weight, rows count so many times."""
    rows = dealt(train, weight) if weight else train
    out = _average_precisions({str(sorted(s.items())): (gbt(features, label, weight, **s), rows, features) for s in settings}, test, label, weight)
    return train.sparkSession.createDataFrame(out, "setting string, ap double")

"""The whole linkage of two sources: normalise, block, describe, learn, stack, decide, write.

learn() works on labelled records and returns what it learned; Learned.save() and load() keep it, and predict() decides about
other records with it, without a truth table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.addresses import PlaceTables, with_addresses
from ..functions.expressions import crc_split, uniform
from ..functions.names import with_names
from ..operators import blocking as B
from ..operators import evaluation as V
from ..operators import features as X
from ..operators import learning as L
from ..operators.selection import resolve
from ..sources.tables import materialized, read_small_json, write_small_json, write_submission


@dataclass
class Settings:
    key_cap: int = B.KEY_CAP
    forward: int = B.FORWARD
    reverse: int = B.REVERSE
    dims: tuple[int, int] = (192, 128)
    vector_blocking: bool = True
    rounds: int = 20
    thresholds: list[float] = field(default_factory=lambda: [round(0.3 + 0.01 * i, 2) for i in range(70)])


# --- records ------------------------------------------------------------------------------------------------------------


def normalized(records: DataFrame, places: PlaceTables | None = None, regions: DataFrame | None = None) -> DataFrame:
    """Records (entity_id, business_name, business_address, country) with all fields of name and address. regions: where
    localities lie, for addresses that name no region."""
    named = with_names(records, "business_name", "country")
    out = with_addresses(named, "business_address", places).withColumn("country", F.coalesce("country", F.lit("")))
    if regions is None:
        return out
    return L.impute_regions(out.withColumn("locs", _localities()), regions).select(out.columns)


def _localities() -> Column:
    return F.filter(F.split("addr_locality", r"[|]"), lambda x: x != "")


def learned_regions(s1: DataFrame) -> DataFrame:
    """Where localities lie, from normalised left-hand records."""
    return L.region_map(s1.select("country", F.explode(_localities()).alias("loc"), F.col("addr_region").alias("region")))


def learned_aliases(s1: DataFrame, s23: DataFrame, truth: DataFrame, **bounds) -> list[tuple[str, str, int]]:
    """Components of addresses that true partners write otherwise: a small table, as each has min_count cases at least and
    there are only so many names of places."""
    parts = lambda df, key, name: df.select(F.col("entity_id").alias(key), F.filter(F.concat(_localities(), F.array("addr_region")), lambda x: (x != "") & ~F.rlike(x, F.lit("[0-9]"))).alias(name))
    pairs = truth.select("s1", "s23").join(parts(s1, "s1", "a"), "s1").join(parts(s23, "s23", "b"), "s23")
    every = parts(s1, "id", "p").unionByName(parts(s23, "id", "p")).select("id", F.explode("p").alias("part"))
    return [(r["variant"], r["canonical"], r["n"]) for r in L.mine_aliases(pairs, every, **bounds).orderBy(F.desc("n"), "variant", "canonical").collect()]


# --- candidates ---------------------------------------------------------------------------------------------------------

#: Parts of a record's vectors and their weights (fixed values): what, of grams or words, weight, and block.
PARTS = (("core", "grams", 1.0, "name"), ("core", "words", 1.0, "name"), ("skel", "words", 0.7, "name"), ("norm", "words", 1.0, "address"), ("number", "words", 1.0, "address"), ("locality", "words", 0.7, "address"), ("street", "grams", 0.7, "address"), ("region", "words", 0.3, "address"))
#: Shares of the blocks in the cosine of two records.
BLOCKS = {"name": 0.6, "address": 0.4}


def vector_texts() -> dict[str, Column]:
    """The texts of the parts: localities are one word each, a house number and a region are marked as such."""
    marked = lambda mark, c: F.when(F.col(c) != "", F.concat(F.lit(mark), c)).otherwise("")
    return {"core": F.col("name_core"), "skel": F.col("name_skel"), "norm": F.col("addr_norm"), "number": marked("h", "addr_hnum"), "locality": F.replace(F.replace("addr_locality", F.lit(" "), F.lit("_")), F.lit("|"), F.lit(" ")), "street": F.col("addr_street"), "region": marked("r", "addr_region")}


def part_weights(records: DataFrame) -> DataFrame:
    """(id, block, term, w) of all parts: weights of length one per part, times the part's weight."""
    texts, own = vector_texts(), F.col("entity_id").alias("id")
    terms = lambda text, kind: B.char_grams(text) if kind == "grams" else F.filter(F.split(text, " "), lambda w: w != "")
    parts = F.array(*[F.struct(F.lit(f"{name}.{kind}").alias("part"), terms(texts[name], kind).alias("terms")) for name, kind, *_ in PARTS])
    every = records.select(own, F.explode(parts).alias("x")).select("id", "x.part", F.explode("x.terms").alias("term"))
    of = F.broadcast(records.sparkSession.createDataFrame([(f"{n}.{k}", b, w) for n, k, w, b in PARTS], "part string, block string, share double"))
    w = B.tfidf(every, "part").join(of, "part")
    return w.select("id", "block", F.concat("part", F.lit(":"), "term").alias("term"), (F.col("w") * F.col("share")).alias("w"))


def record_vectors(records: DataFrame, dims: tuple[int, int], seed: int = 1) -> DataFrame:
    """(group, id, vector): the projected name and address blocks, each of length one, under the roots of their shares. A
    blank address is a block of zeros."""
    w = materialized(part_weights(records))
    out = records.select(F.col("country").alias("group"), F.col("entity_id").alias("id"))
    scaled = []
    for (block, share), n in zip(BLOCKS.items(), dims, strict=True):
        v = B.projected_vectors(w.where(F.col("block") == block), n, seed, share**0.5).withColumnRenamed("vector", block)
        out = out.join(v, "id", "left")
        scaled.append(F.coalesce(F.col(block), F.array_repeat(F.lit(0.0), n)))
    return out.select("group", "id", F.concat(*scaled).alias("vector"))


def candidates(s1: DataFrame, s23: DataFrame, settings: Settings) -> DataFrame:
    """Pairs by exact keys and by nearest vectors."""
    k1 = B.key_families(s1).withColumnRenamed("entity_id", "s1")
    k23 = B.key_families(s23).withColumnRenamed("entity_id", "s23")
    by_key = B.shared_key_pairs(k1, k23, settings.key_cap)
    if not settings.vector_blocking:
        return by_key.select("s1", "s23", "n_keys", F.lit(0.0).alias("cos"), F.lit(None).cast("int").alias("rank_fwd"), F.lit(None).cast("int").alias("rank_rev"))
    tag = F.lit(True).alias("left")
    both = s1.select("*", tag).unionByName(s23.select("*", F.lit(False).alias("left")))
    v = materialized(record_vectors(both, settings.dims).join(both.select(F.col("entity_id").alias("id"), "left"), "id"))
    near = B.nearest_both_ways(v.where("left").drop("left"), v.where("not left").drop("left"), settings.forward, settings.reverse)
    return B.union_candidates(by_key, B.merge_directions(near), settings.forward)


# --- scores -------------------------------------------------------------------------------------------------------------


def features(pairs: DataFrame, s1: DataFrame, s23: DataFrame) -> DataFrame:
    return X.competition_features(X.pair_features(pairs, s1, s23))


BASE = X.PAIR_FEATURES + X.COMPETITION_FEATURES


def anchor_texts(s23: DataFrame) -> DataFrame:
    return s23.select(F.col("entity_id").alias("id"), F.col("name_core").alias("name"), F.col("name_skel").alias("skel"), F.col("addr_norm").alias("addr"), F.col("addr_hnum").alias("hnum"))


def in_context(one: DataFrame, names: DataFrame) -> tuple[DataFrame, list[str]]:
    """First-stage scores with their context and anchors; and all features of the second stage."""
    sourced = one.withColumn("src", F.substring(F.col("s23").cast("string"), 1, 2))
    two = materialized(L.anchor_features(L.group_context(sourced), L.anchors(one), names))
    context = [c for c in two.columns if c.startswith("anc_") or "_p_" in c or "_sure_" in c or c == "c1_n_same_source"]
    return two, [*BASE, "p1", *sorted(context)]


def fit_scores(described: DataFrame, names: DataFrame, rounds: int) -> tuple[list, list, DataFrame]:
    """First- and second-stage models, and (s1, s23, y, is_val, p1, p): first-stage scores out of fold, and the mean of two
    second-stage models on them and their context. described: features with y and is_val. Models learn from a stratified,
    weighted and balanced sample of the rows that are not held out."""
    described = materialized(described)
    train = described.where(~F.col("is_val")).withColumn("stratum", L.pair_stratum(F.col("y") == 1))
    u = uniform(F.concat_ws("|", F.col("s1").cast("string"), F.col("s23").cast("string")), 7)
    sampled = materialized(L.balanced(L.stratified_sample(train, "stratum", u, L.STRATA_CAPS, L.STRATA_BOOSTS), "y"))
    first = L.fold_models(sampled, BASE, "y", "weight", rounds=rounds)
    one = materialized(L.fold_scores(first, described, BASE, F.col("is_val")))
    two, every = in_context(one, names)
    weighted = L.filled(two, every).join(sampled.select("s1", "s23", "weight"), ["s1", "s23"])
    weighted = materialized(weighted)
    second = [L.gbt(every, weight="weight", rounds=rounds, depth=d, seed=s, stepSize=r).fit(weighted) for d, s, r in ((5, 1, 0.15), (4, 2, 0.1))]
    return first, second, second_scores(second, two, every).select("s1", "s23", "y", "is_val", "p1", "p")


def second_scores(models: list, two: DataFrame, every: list[str]) -> DataFrame:
    for k, m in enumerate(models):
        two = L.scored(m, two, every, f"_m{k}")
    return two.withColumn("p", sum((F.col(f"_m{k}") for k in range(len(models))), F.lit(0.0)) / len(models))


def apply_scores(first: list, second: list, described: DataFrame, names: DataFrame) -> DataFrame:
    """(s1, s23, p1, p) of pairs that no model has seen."""
    one = materialized(L.fold_scores(first, materialized(described), BASE, F.lit(True)))
    return second_scores(second, *in_context(one, names)).select("s1", "s23", "p1", "p")


# --- the whole ----------------------------------------------------------------------------------------------------------


@dataclass
class Learned:
    """What is learned from labelled records, and kept for others."""

    aliases: list[tuple[str, str, int]]
    regions: DataFrame
    first: list
    second: list
    threshold: float
    settings: Settings = field(default_factory=Settings)

    def save(self, folder: str) -> None:
        """Writes models, tables and numbers below a folder that Spark can write to."""
        for name in ("first", "second"):
            for k, model in enumerate(getattr(self, name)):
                model.write().overwrite().save(f"{folder}/{name}-{k}")
        self.regions.write.mode("overwrite").parquet(f"{folder}/regions")
        kept = {"aliases": self.aliases, "threshold": self.threshold, "models": [len(self.first), len(self.second)], "settings": vars(self.settings)}
        write_small_json(self.regions.sparkSession, kept, f"{folder}/learned")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> Learned:
        kept = read_small_json(spark, f"{folder}/learned")
        first, second = ([PipelineModel.load(f"{folder}/{name}-{k}") for k in range(n)] for name, n in zip(("first", "second"), kept["models"], strict=True))
        settings = Settings(**(kept["settings"] | {"dims": tuple(kept["settings"]["dims"])}))
        return Learned([tuple(x) for x in kept["aliases"]], spark.read.parquet(f"{folder}/regions"), first, second, kept["threshold"], settings)


def learn(spark: SparkSession, s1_raw: DataFrame, s23_raw: DataFrame, truth: DataFrame, settings: Settings | None = None) -> tuple[Learned, dict]:
    """Learns from the records outside the held-out split, and decides about all. Returns what was learned; and matches,
    candidates, threshold, held-out score and scores."""
    settings = settings or Settings()
    known = truth.join(s1_raw.select(F.col("entity_id").alias("s1")).where(~crc_split("s1")), "s1", "left_semi")
    plain1, plain23 = materialized(normalized(s1_raw)), materialized(normalized(s23_raw))
    aliases = learned_aliases(plain1, plain23, known)
    places = PlaceTables(learned=aliases)
    if aliases:
        plain1 = materialized(normalized(s1_raw, places))
    regions = materialized(learned_regions(plain1))
    s1, s23 = (materialized(normalized(raw, places, regions)) for raw in (s1_raw, s23_raw))
    cand = materialized(candidates(s1, s23, settings))
    labelled = features(cand, s1, s23).join(truth.select("s1", "s23", F.lit(1).alias("y")), ["s1", "s23"], "left").withColumns({"y": F.coalesce("y", F.lit(0)).cast("double"), "is_val": crc_split("s1")})
    first, second, scores = fit_scores(labelled, anchor_texts(s23), settings.rounds)
    p = materialized(scores)
    claims = resolve(p.select("s1", "s23", "p"))
    val = s1.select(F.col("entity_id").alias("s1")).where(crc_split("s1"))
    best = V.best_threshold(V.threshold_sweep(claims.join(val, "s1", "left_semi"), truth.join(val, "s1", "left_semi"), val, settings.thresholds)).first()
    learned = Learned(aliases, regions, first, second, best["threshold"], settings)
    return learned, {"matches": claims.where(F.col("p") >= best["threshold"]), "candidates": cand, "threshold": best["threshold"], "f05": best["f05"], "scores": p}


def predict(spark: SparkSession, learned: Learned, s1_raw: DataFrame, s23_raw: DataFrame) -> dict:
    """Matches, candidates and scores of records without a truth table, by what was learned from others."""
    places = PlaceTables(learned=learned.aliases)
    s1, s23 = (materialized(normalized(raw, places, learned.regions)) for raw in (s1_raw, s23_raw))
    cand = materialized(candidates(s1, s23, learned.settings))
    p = materialized(apply_scores(learned.first, learned.second, features(cand, s1, s23), anchor_texts(s23)))
    return {"matches": resolve(p.select("s1", "s23", "p")).where(F.col("p") >= learned.threshold), "candidates": cand, "scores": p}


def link(spark: SparkSession, s1_raw: DataFrame, s23_raw: DataFrame, truth: DataFrame, folder: str | None = None, settings: Settings | None = None) -> dict:
    """learn(), with both lists and what was learned written below a folder."""
    learned, out = learn(spark, s1_raw, s23_raw, truth, settings)
    if folder:
        write_submission(s1_raw.select(F.col("entity_id").alias("s1")), out["matches"], out["candidates"], folder)
        learned.save(f"{folder}/learned")
    return out


# --- the test tables ----------------------------------------------------------------------------------------------------

#: Ways to write a legal form, dealt by number, so that the rules have something to do.
FORMS = ("Ltd", "private limited", "(ID: 12345)", "| tail text", "& Sons", "L.L.C.", "Inc.", "")


def part_records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """part read as two sources of records: names with a legal form, addresses of house number, street and place, the brand as
    country. True pairs have the same name, place and house number."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    key = F.col("p_partkey")
    house = F.floor(F.col("p_size") / 5).cast("string")
    forms = F.element_at(F.array(*map(F.lit, FORMS)), (key % len(FORMS) + 1).cast("int"))
    street = F.when(key % 2 == 0, "Street").otherwise("St")
    place = F.concat(F.initcap("p_type"), F.lit(" City"))
    r = p.select(F.concat(F.when(key % 3 == 0, "S1-").when(key % 3 == 1, "S2-").otherwise("S3-"), key.cast("string")).alias("entity_id"), F.concat_ws(" ", "p_name", forms).alias("business_name"), F.concat(house, F.lit(" "), F.initcap(F.split_part("p_name", F.lit(" "), F.lit(1))), F.lit(" "), street, F.lit(", "), place).alias("business_address"), F.col("p_brand").alias("country"), F.concat_ws("|", "p_brand", "p_name", "p_type", house).alias("key"))
    s1 = r.where("entity_id like 'S1-%'")
    s1 = s1.join(s1.groupBy("key").agg(F.min("entity_id").alias("entity_id")), ["key", "entity_id"], "left_semi")
    s23 = r.where("entity_id not like 'S1-%'")
    truth = s1.select("key", F.col("entity_id").alias("s1")).join(s23.select("key", F.col("entity_id").alias("s23")), "key").select("s1", "s23")
    return s1.drop("key"), s23.drop("key"), truth


def labelled_features_of_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s1_raw, s23_raw, truth = part_records(spark, sf_dir)
    s1, s23 = materialized(normalized(s1_raw)), materialized(normalized(s23_raw))
    pairs = materialized(candidates(s1, s23, Settings()))
    out = features(pairs, s1, s23).join(truth.select("s1", "s23", F.lit(1).alias("y")), ["s1", "s23"], "left")
    return out.withColumns({"y": F.coalesce("y", F.lit(0)).cast("double"), "is_val": crc_split("s1")}), s23


def features_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled_features_of_parts(spark, sf_dir)[0].drop("y", "is_val")

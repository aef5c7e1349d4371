"""Measures of predicted pairs against true pairs, and reports on them. All are aggregates over joins on ids."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import safe_divide
from .selection import running_totals


def per_entity(predicted: DataFrame, truth: DataFrame, ids: DataFrame) -> DataFrame:
    """(s1, tp, np, nt, f): F0.5 of each left-hand record; one without true partners scores 1 if none is predicted."""
    pred, true = predicted.select("s1", "s23").distinct(), truth.select("s1", "s23").distinct()
    count = lambda df, name: df.groupBy("s1").agg(F.count("*").alias(name))
    out = ids.select("s1").distinct()
    for df, name in ((pred.join(true, ["s1", "s23"], "left_semi"), "tp"), (pred, "np"), (true, "nt")):
        out = out.join(count(df, name), "s1", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    p, r = safe_divide("tp", "np"), safe_divide("tp", "nt")
    f = F.when(F.col("nt") == 0, (F.col("np") == 0).cast("double")).otherwise(safe_divide(1.25 * p * r, 0.25 * p + r))
    return out.withColumn("f", f)


def summary(entities: DataFrame, by: list[str] | None = None, undefined: float = 0.0) -> DataFrame:
    """Macro F0.5, precision and recall, micro precision and recall (undefined, where there is nothing to divide by: 0 as a
    rule), accuracy on records without partners."""
    micro = lambda of: F.when(F.sum(of) == 0, F.lit(undefined)).otherwise(F.sum("tp") / F.sum(of))
    own, claimed = F.col("nt") > 0, (F.col("nt") > 0) & (F.col("np") > 0)
    aggs = [
        F.count("*").alias("n"),
        F.avg("f").alias("f05"),
        F.avg(F.when(claimed, F.col("tp") / F.greatest("np", F.lit(1)))).alias("p_macro"),
        F.avg(F.when(own, F.col("tp") / F.greatest("nt", F.lit(1)))).alias("r_macro"),
        micro("np").alias("p_micro"),
        micro("nt").alias("r_micro"),
        F.avg(F.when(~own, F.col("f"))).alias("singleton_acc"),
    ]
    return (entities.groupBy(*by) if by else entities).agg(*aggs)


def segment_report(entities: DataFrame, segment: Column) -> DataFrame:
    """(segment, n, mean_f, loss): the share of all lost score that falls into each segment."""
    g = entities.groupBy(segment.alias("segment")).agg(F.count("*").alias("n"), F.avg("f").alias("mean_f"), F.sum(1 - F.col("f")).alias("lost"))
    return g.select("segment", "n", "mean_f", safe_divide("lost", F.sum("lost").over(Window.partitionBy())).alias("loss"))


def segment_reports(entities: DataFrame, segments: dict[str, Column]) -> DataFrame:
    """segment_report() of several kinds of segments in one pass: (kind, segment, n, mean_f, loss)."""
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("string").alias("segment")) for k, c in segments.items()])).alias("x")
    g = entities.select("f", rows).select("f", "x.*").groupBy("kind", "segment").agg(F.count("*").alias("n"), F.avg("f").alias("mean_f"), F.sum(1 - F.col("f")).alias("lost"))
    return g.select("kind", "segment", "n", "mean_f", safe_divide("lost", F.sum("lost").over(Window.partitionBy("kind"))).alias("loss"))


def error_decomposition(predicted: DataFrame, truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """(item, n): true and false positives and negatives; false positives by whether their record has an owner; false
    negatives by whether they were candidates; predictions for records without partners.

    All pairs are put together once with flags of where they are from; owners and partners are one look-up each.
    """
    tagged = [df.select("s1", "s23", *[F.lit(int(k == n)).alias(n) for n in ("p", "t", "c")]) for k, df in (("p", predicted), ("t", truth), ("c", candidates))]
    pairs = tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).groupBy("s1", "s23").agg(*[F.max(n).alias(n) for n in "ptc"]).where("p + t > 0")
    owned = pairs.groupBy("s23").agg(F.max("t").alias("owned"))
    matched = pairs.groupBy("s1").agg(F.max("t").alias("matched"))
    all_ = pairs.join(owned, "s23").join(matched, "s1")
    fp, fn = (F.col("p") == 1) & (F.col("t") == 0), (F.col("p") == 0) & (F.col("t") == 1)
    parts = {"tp": (F.col("p") == 1) & (F.col("t") == 1), "fp": fp, "fp_owned": fp & (F.col("owned") == 1), "fp_distractor": fp & (F.col("owned") == 0), "fp_singleton": fp & (F.col("matched") == 0), "fn": fn, "fn_not_candidate": fn & (F.col("c") == 0), "fn_below": fn & (F.col("c") == 1)}
    one = all_.agg(*[F.count_if(x).alias(k) for k, x in parts.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("item"), F.col(k).alias("n")) for k in parts])).alias("x")).select("x.*")


def candidate_stats(candidates: DataFrame, ids: DataFrame, right: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: pairs, candidates per left-hand record (mean, median, max), reduction ratio, recall. right: a row per
    right-hand record."""
    n = ids.select("s1").join(candidates.groupBy("s1").agg(F.count("*").alias("k")), "s1", "left").select(F.coalesce("k", F.lit(0)).alias("k"))
    found = truth.join(candidates, ["s1", "s23"], "left_semi").agg(F.count("*").alias("found")).join(truth.agg(F.count("*").alias("truth")))
    size = n.agg(F.sum("k").alias("pairs"), F.avg("k").alias("mean"), F.percentile("k", F.lit(0.5)).alias("median"), F.max("k").alias("most"), F.count("*").alias("n1"))
    return size.join(found).join(right.agg(F.count("*").alias("n23"))).select("pairs", "mean", "median", "most", (1 - F.col("pairs") / (F.col("n1") * F.col("n23"))).alias("reduction"), safe_divide("found", "truth").alias("recall"))


def average_precision(scored: DataFrame, score: str, label: str, weight: str | None = None) -> DataFrame:
    """One row (ap): the sum over distinct scores, descending, of recall gained times precision. A row counts weight times."""
    n = F.col(weight).cast("double") if weight else F.lit(1.0)
    g = scored.groupBy(score).agg(F.sum(F.col(label).cast("double") * n).alias("tp"), F.sum(n).alias("n"))
    run = running_totals(g, [F.desc(score)], {"ctp": F.col("tp"), "cn": F.col("n")})
    return run.agg(safe_divide(F.sum(F.col("tp") * F.col("ctp") / F.col("cn")), F.sum("tp")).alias("ap"))


def threshold_sweep(claims: DataFrame, truth: DataFrame, ids: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, f05) of the pairs at or above each threshold. claims: (s1, s23, p), resolved or not, each pair once.

    Pairs are labelled and put into the step of the highest threshold they pass; sums over steps per record then give the
    counts at all thresholds, so pairs are read once whatever the number of thresholds, and a record has at most as many rows as
    it has claims.
    """
    spark, thresholds = claims.sparkSession, sorted(thresholds)
    steps = spark.createDataFrame(list(enumerate(thresholds)), "step int, threshold double")
    level = F.size(F.filter(F.array(*map(F.lit, thresholds)), lambda t: t <= F.col("p"))) - 1
    labelled = claims.join(truth.select("s1", "s23", F.lit(1).alias("y")), ["s1", "s23"], "left")
    counts = labelled.select("s1", F.coalesce("y", F.lit(0)).alias("y"), level.alias("top")).where("top >= 0").groupBy("s1", "top").agg(F.sum("y").alias("tp"), F.count("*").alias("np"))
    # from a record's next lower step on, down to this one, its counts are those at or above this one
    down = Window.partitionBy("s1").orderBy(F.desc("top"))
    run = down.rowsBetween(Window.unboundedPreceding, 0)
    at = counts.select("s1", "top", F.sum("tp").over(run).alias("tp"), F.sum("np").over(run).alias("np"), F.coalesce(F.lead("top").over(down), F.lit(-1)).alias("below"))
    nt = truth.groupBy("s1").agg(F.count("*").alias("nt"))
    base = ids.select("s1").join(nt, "s1", "left").withColumn("nt", F.coalesce("nt", F.lit(0)))
    p, r = safe_divide("tp", "np"), safe_divide("tp", "nt")
    own = at.join(base, "s1").withColumn("f", F.when(F.col("nt") > 0, safe_divide(1.25 * p * r, 0.25 * p + r)).otherwise(0.0))
    # differences at the ends of each stretch, added up over the steps
    spoilt = (F.col("nt") == 0).cast("long")
    ends = own.select(F.explode(F.array(F.struct(F.col("top").alias("step"), F.col("f").alias("f"), spoilt.alias("spoilt")), F.struct(F.col("below").alias("step"), (-F.col("f")).alias("f"), (-spoilt).alias("spoilt")))).alias("x")).select("x.*")
    change = ends.where("step >= 0").groupBy("step").agg(F.sum("f").alias("f"), F.sum("spoilt").alias("spoilt"))
    back = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    # records without a claim at a step: 1 each for those without partners, which lose it with their first claim
    total = base.agg(F.count("*").alias("n"), F.sum((F.col("nt") == 0).cast("long")).alias("alone"))
    out = steps.join(change, "step", "left").select("threshold", F.sum(F.coalesce("f", F.lit(0.0))).over(back).alias("f"), F.sum(F.coalesce("spoilt", F.lit(0))).over(back).alias("spoilt"))
    return out.join(F.broadcast(total)).select("threshold", ((F.col("f") + F.col("alone") - F.col("spoilt")) / F.col("n")).alias("f05"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    return sweep.orderBy(F.desc("f05"), "threshold").limit(1)


def contested(claims: DataFrame, threshold: float) -> DataFrame:
    """One row: right-hand records claimed more than once at a threshold, and the claims that lose."""
    g = claims.where(F.col("p") >= threshold).groupBy("s23").agg(F.count("*").alias("k")).where("k > 1")
    return g.agg(F.count("*").alias("records"), F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("lost_claims"))


def density_reweight(entities: DataFrame, bucket: str, target: DataFrame) -> DataFrame:
    """(bucket, mean_f, share, target_share, weighted): scores of one set under the bucket shares of another."""
    own = entities.groupBy(bucket).agg(F.avg("f").alias("mean_f"), F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
    other = target.groupBy(bucket).agg(F.count("*").alias("m")).withColumn("target_share", F.col("m") / F.sum("m").over(Window.partitionBy()))
    both = own.join(other, bucket, "full")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return both.select(bucket, "mean_f", zero("share").alias("share"), zero("target_share").alias("target_share"), (zero("mean_f") * zero("target_share")).alias("weighted"))


def bootstrap_ci(diffs: DataFrame, column: str, rounds: int = 2000, seed: int = 42, bins: int = 4096) -> DataFrame:
    """One row (mean, lo, hi, p_not_better, better, worse, unchanged) of paired differences.

    A resample of n rows depends only on how often each value is drawn. Values are put into at most `bins` ranges of equal
    width (each value a bin of its own if there are no more), with their counts and exact sums: what the driver draws from
    has that many rows, whatever the column. Within a bin, values stand for their mean.
    """
    v = F.col(column).cast("double")
    ends = diffs.agg(F.min(v).alias("low"), F.max(v).alias("high")).first()
    low, width = ends["low"] or 0.0, ((ends["high"] or 0.0) - (ends["low"] or 0.0)) / bins
    few = diffs.select(v.alias("v")).where("v is not null").distinct().limit(bins + 1).count() <= bins
    place = v if few or not width else F.least(F.floor((v - low) / width), F.lit(bins - 1))
    rows = diffs.where(v.isNotNull()).groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.sum(v).alias("s"), F.count_if(v > 0).alias("better"), F.count_if(v < 0).alias("worse")).collect()
    rows.sort(key=lambda r: r["bin"])
    n, s = np.array([r["n"] for r in rows], float), np.array([r["s"] for r in rows], float)
    total = n.sum()
    rng = np.random.default_rng(seed)
    means = np.array([rng.multinomial(int(total), n / total) @ (s / n) / total for _ in range(rounds)]) if len(rows) else np.zeros(1)
    lo, hi = np.percentile(means, [2.5, 97.5])
    better, worse = (sum(r[k] for r in rows) for k in ("better", "worse"))
    out = (float(s.sum() / max(1, total)), float(lo), float(hi), float((means <= 0).mean()), int(better), int(worse), int(total - better - worse))
    return diffs.sparkSession.createDataFrame([out], "mean double, lo double, hi double, p_not_better double, better long, worse long, unchanged long")


def feature_drift(a: DataFrame, b: DataFrame, features: list[str]) -> DataFrame:
    """(feature, mean_a, mean_b, sd_a, null_a, constant, sparse, drifted): one pass over each side."""

    def profile(df: DataFrame, tag: str) -> DataFrame:
        one = df.agg(*[x for f in features for x in (F.avg(f).alias(f"m_{f}"), F.stddev_samp(f).alias(f"s_{f}"), F.avg(F.col(f).isNull().cast("double")).alias(f"n_{f}"))])
        rows = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"m_{f}").alias(f"mean_{tag}"), F.col(f"s_{f}").alias(f"sd_{tag}"), F.col(f"n_{f}").alias(f"null_{tag}")) for f in features]))
        return one.select(rows.alias("x")).select("x.*")

    j = profile(a, "a").join(profile(b, "b"), "feature")
    return j.select("feature", "mean_a", "mean_b", "sd_a", "null_a", (F.coalesce("sd_a", F.lit(0.0)) == 0).alias("constant"), (F.col("null_a") > 0.3).alias("sparse"), (F.abs(F.col("mean_a") - F.col("mean_b")) > 0.5 * F.col("sd_a")).alias("drifted"))


def recall_cost_grid(truth: DataFrame, candidates: DataFrame, left: DataFrame, depths: list[int]) -> DataFrame:
    """(depth, with_keys, recall, per_record) of candidates cut to a forward depth, with and without the key channel.

    Each candidate goes to the least depth at which it is there, per channel setting; sums up to each depth follow from
    those of the steps, so a candidate is read once whatever the grid.
    """
    spark, depths = candidates.sparkSession, sorted(depths)
    always, last = F.col("rank_rev").isNotNull(), F.lit(len(depths))
    step = F.coalesce(last - F.size(F.filter(F.array(*map(F.lit, depths)), lambda d: F.col("rank_fwd") <= d)), last)
    steps = [F.when(always | (k & (F.col("n_keys") > 0)), 0).when(F.col("rank_fwd").isNull(), last).otherwise(step) for k in (F.lit(True), F.lit(False))]
    hit = candidates.join(truth.select("s1", "s23", F.lit(1).alias("_y")), ["s1", "s23"], "left")
    each = hit.select("_y", F.explode(F.array(*[F.struct(F.lit(k).alias("with_keys"), x.alias("step")) for k, x in zip((True, False), steps, strict=True)])).alias("x")).select("_y", "x.*")
    counts = each.where(F.col("step") < last).groupBy("with_keys", "step").agg(F.count("_y").alias("found"), F.count("*").alias("pairs"))
    grid = spark.createDataFrame([(i, d, k) for i, d in enumerate(depths) for k in (True, False)], "step int, depth int, with_keys boolean")
    run = Window.partitionBy("with_keys").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    both = grid.join(counts, ["with_keys", "step"], "left").withColumns({c: F.sum(F.coalesce(c, F.lit(0))).over(run) for c in ("found", "pairs")})
    n = truth.agg(F.count("*").alias("_n")).join(left.agg(F.count("*").alias("_left")))
    return both.join(F.broadcast(n)).select("depth", "with_keys", safe_divide("found", "_n").alias("recall"), (F.col("pairs") / F.col("_left")).alias("per_record"))


def competitors(scored: DataFrame, val_ids: DataFrame) -> DataFrame:
    """The pairs of held-out records and those of other records that claim one of the same right-hand records."""
    own = scored.join(val_ids.select("s1"), "s1", "left_semi")
    return scored.join(own.select("s23").distinct(), "s23", "left_semi")


def agreement_rates(pairs: DataFrame, fields: dict[str, tuple[str, str]], by: str) -> DataFrame:
    """Share of pairs whose two columns are equal and not empty, per group."""
    rate = lambda a, b: F.avg(F.coalesce((F.col(a) == F.col(b)) & (F.col(a) != ""), F.lit(False)).cast("double"))
    return pairs.groupBy(by).agg(F.count("*").alias("n"), *[rate(a, b).alias(k) for k, (a, b) in fields.items()])

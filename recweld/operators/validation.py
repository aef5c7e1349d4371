"""Rules that a result must meet, as a table of (rule, n): how many violations there are. Examples are the caller's to take."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _rule(name: str, violations: DataFrame) -> DataFrame:
    return violations.agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n")


def exploded(lists: DataFrame) -> DataFrame:
    """(s1, s23) of id lists (source1_entity_id, ids), repeats kept."""
    return lists.select(F.col("source1_entity_id").alias("s1"), F.explode(F.split(F.coalesce("ids", F.lit("")), ",")).alias("s23")).where("s23 <> ''")


def list_rules(lists: DataFrame, ids: DataFrame, right_ids: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """Rules on id lists: one row per left-hand id, none missing or foreign, no repeats in a list, no left-hand ids in it,
    only known ids, each used once; and as a warning, all of them candidates."""
    pairs = exploded(lists)
    left = lists.select(F.col("source1_entity_id").alias("s1"))
    rules = {
        "repeated_rows": left.groupBy("s1").count().where("count > 1"),
        "missing_rows": ids.select("s1").join(left, "s1", "left_anti"),
        "foreign_rows": left.join(ids, "s1", "left_anti"),
        "repeated_in_list": pairs.groupBy("s1", "s23").count().where("count > 1"),
        "left_ids_in_list": pairs.join(ids.select(F.col("s1").alias("s23")), "s23", "left_semi"),
        "unknown_ids": pairs.join(right_ids, "s23", "left_anti"),
        "used_more_than_once": pairs.select("s1", "s23").distinct().groupBy("s23").count().where("count > 1"),
    }
    if candidates is not None:
        rules["warning_not_candidates"] = pairs.join(candidates, ["s1", "s23"], "left_anti")
    return reduce(DataFrame.unionByName, [_rule(k, v) for k, v in rules.items()])


def file_rules(lines: DataFrame, header: list[str], prefixes: tuple[str, ...] = ("S2-", "S3-")) -> DataFrame:
    """Rules on the raw lines of a list file (value, first: whether it is the first line): header, commas for tabs, fields,
    empty or padded ids, prefixes, and ids of the left-hand source."""
    fields = F.split("value", "\t")
    body = lines.where("not first")
    ids = body.where(F.size(fields) == 2).select(F.explode(F.split(fields[1], ",")).alias("id"), fields[1].alias("all")).where("all <> ''")
    good = reduce(lambda a, b: a | b, [F.startswith("id", F.lit(p)) for p in prefixes])
    rules = {
        "empty_file": lines.sparkSession.range(1).join(lines.limit(1), F.lit(True), "left_anti"),
        "wrong_header": lines.where("first").where(F.col("value") != "\t".join(header)),
        "commas_for_tabs": lines.where("first").where(F.contains("value", F.lit(",")) & ~F.contains("value", F.lit("\t"))),
        "malformed_rows": body.where(F.size(fields) != 2),
        "empty_row_id": body.where(F.trim(fields[0]) == ""),
        "empty_ids": ids.where("trim(id) = '' or id <> trim(id)"),
        "wrong_prefix": ids.where(~good & (F.trim("id") != "") & ~F.startswith("id", F.lit("S1-"))),
        "left_ids_in_list": ids.where(F.startswith("id", F.lit("S1-"))),
    }
    return reduce(DataFrame.unionByName, [_rule(k, v) for k, v in rules.items()])


def read_lines(spark, path: str) -> DataFrame:
    """(value, first) of a text file. The first line is that of the smallest file offset."""
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    return lines.join(F.broadcast(lines.agg(F.min("at").alias("least")))).select("value", (F.col("at") == F.col("least")).alias("first"))


def file_report(spark, path: str, header: list[str], **rules) -> DataFrame:
    """file_rules() of a file, and whether it is there at all."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    missing = spark.createDataFrame([("missing_file", int(not there))], "rule string, n long")
    return missing.unionByName(file_rules(read_lines(spark, path), header, **rules)) if there else missing


def examples(violations: DataFrame, order: str, n: int = 5) -> DataFrame:
    return violations.orderBy(order).limit(n)


def pair_agreement(a: DataFrame, b: DataFrame, by: DataFrame | None = None) -> DataFrame:
    """One row per group of left-hand ids (by: s1, group): pairs of each side, shared pairs, their Jaccard similarity, and the
    share of ids whose lists are the same (empty ones included, if by names their ids)."""
    side = lambda df, c: df.select("s1", "s23", F.lit(1).alias(c)).distinct()
    both = side(a, "x").join(side(b, "y"), ["s1", "s23"], "full")
    each = both.groupBy("s1").agg(F.count("x").alias("n_a"), F.count("y").alias("n_b"), F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("shared"), F.count("*").alias("n"))
    each = by.join(each, "s1", "left") if by is not None else each.withColumn("group", F.lit("all"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_a", "n_b", "shared", "n")}
    n = each.withColumns(zero).groupBy("group").agg(*[F.sum(c).alias(c) for c in zero], F.avg(((F.col("n_a") == F.col("shared")) & (F.col("n_b") == F.col("shared"))).cast("double")).alias("identical"))
    return n.select("group", "n_a", "n_b", "shared", F.try_divide("shared", "n").alias("jaccard"), "identical")

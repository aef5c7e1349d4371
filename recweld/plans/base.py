"""The registry of queries, and views of the test tables as records to be linked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blocking import KEY_CAP, within_cap

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with the DuckDB SQL of the same result."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as records: id, country (the brand), name (name, type and size: whole values, ASCII words), source 1 to 3."""
    p = load(spark, sf_dir, "part")
    name = F.trim(F.regexp_replace(F.lower(F.concat_ws(" ", "p_name", "p_type", F.col("p_size").cast("string"))), "[^a-z0-9]+", " "))
    return p.select(F.col("p_partkey").alias("doc_id"), F.col("p_brand").alias("country"), name.alias("name"), (F.col("p_partkey") % 3 + 1).cast("int").alias("src"))


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """S1: the first record of each country and name of source 1. S23: the records of the other sources."""
    r = records(spark, sf_dir)
    s1 = r.where("src = 1").groupBy("country", "name").agg(F.min("doc_id").alias("s1"))
    return s1, r.where("src <> 1").select("country", "name", F.col("doc_id").alias("s23"), "src")


def first_words(c: str, n: int) -> Column:
    return F.substring_index(c, " ", n)


RECORDS_SQL = """rec AS (SELECT p_partkey AS doc_id, p_brand AS country, trim(regexp_replace(lower(concat_ws(' ', p_name, p_type, p_size::VARCHAR)), '[^a-z0-9]+', ' ', 'g')) AS name, (p_partkey % 3 + 1)::INT AS src FROM part),
s1 AS (SELECT country, name, min(doc_id) AS s1 FROM rec WHERE src = 1 GROUP BY country, name),
s23 AS (SELECT country, name, doc_id AS s23, src FROM rec WHERE src <> 1)"""

#: The first two and three words of a name, in SQL.
TWO, THREE = (lambda c: f"array_to_string(string_split({c}, ' ')[:2], ' ')"), (lambda c: f"array_to_string(string_split({c}, ' ')[:3], ' ')")

#: Pairs of one country whose names begin with the same two words (KEY_CAP records a side at most have them), and their
#: likeness: what the window queries work on. True pairs: those of one country with the same first three words.
PAIRS_SQL = (
    RECORDS_SQL
    + f""",
w1 AS (SELECT *, {TWO("name")} AS word FROM s1), w23 AS (SELECT *, {TWO("name")} AS word FROM s23),
p0 AS (SELECT s1, s23, w1.name AS name1, w23.name AS name2, src FROM w1 JOIN w23 USING (country, word)
 WHERE (country, word) IN (SELECT country, word FROM w1 GROUP BY ALL HAVING count(*) <= {KEY_CAP}) AND (country, word) IN (SELECT country, word FROM w23 GROUP BY ALL HAVING count(*) <= {KEY_CAP})),
pairs AS (SELECT *, round(1.0 - levenshtein(name1, name2) / greatest(length(name1), length(name2), 1), 6) AS score FROM p0),
truth AS (SELECT s1, s23 FROM s1 JOIN s23 ON s1.country = s23.country AND {THREE("s1.name")} = {THREE("s23.name")})"""
)


def scored_pairs(spark: SparkSession, sf_dir: str, cap: int | None = KEY_CAP, counted: bool = False) -> DataFrame:
    """(s1, s23, name1, name2, src, score) of the pairs above; without a cap, of all pairs that share a key. Counted: with n
    in place of s23, the number of a record's pairs with records of the same name and source."""
    s1, s23 = sides(spark, sf_dir)
    key = F.concat_ws("|", F.col("country"), first_words("name", 2)).alias("key")
    left, right = s1.select(key, "s1", F.col("name").alias("name1")), s23.select(key, "s23", F.col("name").alias("name2"), "src")
    if cap is not None:
        left, right = within_cap(left, cap), within_cap(right, cap)
    right_id = "s23"
    if counted:
        right, right_id = right.groupBy("key", "name2", "src").agg(F.count("*").alias("n")), "n"
    score = F.round(1.0 - F.levenshtein("name1", "name2") / F.greatest(F.length("name1"), F.length("name2"), F.lit(1)), 6)
    return left.join(right, "key").select("s1", right_id, "name1", "name2", "src", score.alias("score"))


def true_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s1, s23 = (df.withColumn("core", first_words("name", 3)).drop("name") for df in sides(spark, sf_dir))
    return s1.join(s23, ["country", "core"]).select("s1", "s23")

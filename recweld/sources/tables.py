"""Sources and sinks of a linkage job.

Sources are tab-separated files of all strings without quoting (an empty field is null), and Parquet. Results are
tab-separated lists, one row per left-hand record. Configuration and reports are small JSON and Markdown texts, written
from bounded results. All paths are Spark paths but those of JSON and Markdown, which the driver writes.
"""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])
MODES = ("train", "test")


def data_paths(mode: str, root: str | None = None) -> dict[str, str]:
    """Paths of the three sources and, in train mode, of the truth. The root comes from RECWELD_DATA by default."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    base = f"{root or os.environ.get('RECWELD_DATA', 'data')}/{mode}/{mode}"
    return {f"s{i}": f"{base}_source{i}.tsv" for i in (1, 2, 3)} | ({"truth": f"{base}_ground_truth.tsv"} if mode == "train" else {})


def read_tsv(spark: SparkSession, path: str, schema: T.StructType = RECORD) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", "").option("nullValue", "").csv(path)


def load_sources(spark: SparkSession, mode: str, root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """S1, and S2 with S3."""
    p = data_paths(mode, root)
    return read_tsv(spark, p["s1"]), read_tsv(spark, p["s2"]).unionByName(read_tsv(spark, p["s3"]))


def explode_truth(truth: DataFrame, id_col: str = "source1_entity_id", list_col: str = "matched_entity_ids") -> DataFrame:
    """(s1, s23) of each id in the lists; records without a match have no row."""
    one = F.explode(F.split(F.coalesce(list_col, F.lit("")), ","))
    return truth.select(F.col(id_col).alias("s1"), one.alias("s23")).select("s1", F.trim("s23").alias("s23")).where("s23 <> ''")


def load_truth(spark: SparkSession, root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The exploded pairs, and all left-hand ids."""
    truth = read_tsv(spark, data_paths("train", root)["truth"], TRUTH)
    return explode_truth(truth), truth.select(F.col("source1_entity_id").alias("s1"))


def read_columns(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(columns) if columns else df


def write_parquet(df: DataFrame, path: str, compression: str = "zstd", by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite").option("compression", compression)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """A table whose joins on key with tables of equally many buckets need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def id_lists(ids: DataFrame, pairs: DataFrame, name: str = "matched_entity_ids") -> DataFrame:
    """One row per left-hand id: its partners, distinct, sorted, joined by commas; the empty text without any."""
    own = pairs.groupBy("s1").agg(F.array_join(F.array_sort(F.collect_set("s23")), ",").alias(name))
    return ids.select("s1").join(own, "s1", "left").select(F.col("s1").alias("source1_entity_id"), F.coalesce(name, F.lit("")).alias(name))


def write_lists(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)


def write_submission(ids: DataFrame, matches: DataFrame, candidates: DataFrame, folder: str, prefix: str = "") -> None:
    write_lists(id_lists(ids, matches), f"{folder}/{prefix}matching_results.tsv")
    write_lists(id_lists(ids, candidates, "candidate_entity_ids"), f"{folder}/{prefix}candidate_pairs.tsv")


def write_json(value: object, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, indent=1, ensure_ascii=False, default=str), encoding="utf-8")


def read_json(path: str) -> object:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def write_small_json(spark: SparkSession, value: object, path: str) -> None:
    """A small value as one JSON text under a Spark path, so that any machine can read it."""
    spark.createDataFrame([(json.dumps(value, ensure_ascii=False, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_small_json(spark: SparkSession, path: str) -> object:
    return json.loads(spark.read.text(path).first()["value"])


def markdown(df: DataFrame, most: int = 1000, digits: int = 4) -> str:
    """A Markdown table of the first rows of a small result; numbers rounded."""
    show = lambda v: f"{v:.{digits}f}" if isinstance(v, float) else "" if v is None else str(v)
    rows = [df.columns, ["---"] * len(df.columns), *([show(v) for v in r] for r in df.limit(most).collect())]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows) + "\n"


def sample_rows(df: DataFrame, n: int, key: str | Column, seed: int = 0) -> DataFrame:
    """n rows in the order of a seeded hash of the key: the same for any partitioning."""
    key = F.col(key) if isinstance(key, str) else key
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def materialized(df: DataFrame) -> DataFrame:
    """The rows as a checkpoint in the shared folder (spark.checkpoint.dir). In local mode without one, as in tests, they are
    persisted; a cluster must name one.

    Iterative learners read their input many times; a checkpoint also survives lost executors and cuts the plan.
    """
    context = df.sparkSession.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root and not context.getCheckpointDir():
        context.setCheckpointDir(root)
    if not root and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return df.checkpoint() if root else df.persist()

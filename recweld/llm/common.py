"""Session and storage helpers of the text operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder shared by driver and executors: spark.checkpoint.dir. Only in local mode, as in tests, one is made if none
    is set; a cluster must name one, as what its machines write to folders of their own can't be read by others."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="recweld-"))
        root = context.getCheckpointDir()
    return root.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again, which cuts the lineage and survives lost executors."""
    path = f"{shared_root(df.sparkSession)}/recweld-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh_name(name: str, taken: list[str]) -> str:
    """The name, with as many underscores before it as make it new (letters' case does not count)."""
    own = {c.lower() for c in taken}
    while name.lower() in own:
        name = f"_{name}"
    return name


def small_enough(df: DataFrame, row_bytes: int, most: int = 32 << 20) -> bool:
    """Whether a stored table may be broadcast: its rows are counted."""
    return df.count() * row_bytes <= most


def broadcast_if_small(df: DataFrame, row_bytes: int, most: int = 32 << 20) -> DataFrame:
    """A broadcast hint for a stored table, if its rows are few enough; else it is joined as any other."""
    return F.broadcast(df) if small_enough(df, row_bytes, most) else df


def crc_bucket(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text (crc 0)."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

"""Windows over groups and choices among their rows. Every order is total, so results do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialized


def top_k(df: DataFrame, by: str | list[str], order: list, k: int, name: str | None = None) -> DataFrame:
    """The first k rows of each group; Spark keeps k per group before it shuffles them."""
    n = name or "_n"
    out = df.withColumn(n, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(n) <= k)
    return out if name else out.drop(n)


def running_totals(df: DataFrame, order: list, sums: dict[str, Column]) -> DataFrame:
    """Adds running sums over all rows in a total order, without bringing the rows into one task: rows are sorted by range,
    and each range starts from the sums of those before it (one row per range). The ranges are kept, as drawing them again
    could give others."""
    ranged = materialized(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_part").agg(*[F.sum(c).alias(f"_{k}") for k, c in sums.items()])
    starts = totals.select("_part", *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in sums])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(starts), "_part")
    return out.withColumns({k: F.sum(c).over(inside) + F.col(f"_{k}") for k, c in sums.items()}).drop("_part", *[f"_{k}" for k in sums])


def with_index(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Numbers of the rows from 0 in an order."""
    return running_totals(df, order, {name: F.lit(1)}).withColumn(name, (F.col(name) - 1).cast("long"))


def with_rank_margin(df: DataFrame, by: str, x: str, tie: str, prefix: str = "") -> DataFrame:
    """Adds rank, n and margin: the lead over the second of the group for its best, else the lag behind the best."""
    part = Window.partitionBy(by)
    order = part.orderBy(F.desc(x), tie)
    df = df.withColumns({f"{prefix}rank": F.rank().over(part.orderBy(F.desc(x))).cast("long"), "_place": F.row_number().over(order)})
    df = df.withColumns({f"{prefix}n": F.count("*").over(part), "_first": F.max(x).over(part), "_second": F.max(F.when(F.col("_place") == 2, F.col(x))).over(part)})
    margin = F.when(F.col(x) >= F.col("_first"), F.col(x) - F.when(F.col(f"{prefix}n") > 1, F.col("_second")).otherwise(F.lit(0.0))).otherwise(F.col(x) - F.col("_first"))
    return df.withColumn(f"{prefix}margin", margin).drop("_place", "_first", "_second")


def sum_of_others(x: str, by: str) -> Column:
    return F.sum(x).over(Window.partitionBy(by)) - F.col(x)


def max_of_others(x: str, by: str, tie: str) -> Column:
    """The greatest value of a group's other rows, NULL without any."""
    part = Window.partitionBy(by)
    order = part.orderBy(F.desc(x), tie)
    return F.when(F.row_number().over(order) == 1, F.lead(x).over(order)).otherwise(F.max(x).over(part))


def resolve(pairs: DataFrame, score: str = "p", left: str = "s1", right: str = "s23", threshold: float | None = None) -> DataFrame:
    """One claimant per right-hand record: the best score, then the smallest left-hand id.

    Which claimant wins does not depend on the threshold, so pairs are ranked once and any threshold is a filter after it.
    """
    own = Window.partitionBy(right).orderBy(F.desc(score), left)
    out = pairs.withColumn("_place", F.row_number().over(own)).where("_place = 1").drop("_place")
    return out.where(F.col(score) >= threshold) if threshold is not None else out

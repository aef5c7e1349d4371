"""Connected components of a table of links, by alternating large-star and small-star steps.

Both steps replace links by links to the smallest known neighbour; they keep components as they are and end in one star
per component. Each step is an aggregation by node (partial sums first) and a join back, which adaptive execution splits
where a node has very many links. Steps are stored in the shared folder. Links are never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

MAX_STEPS = 64


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionAll(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (columns a and b of one ordered type, never null). Root: the smallest node."""
    now = stored(links.select("a", "b").where("a <> b").distinct(), "links")
    state = None
    for _ in range(MAX_STEPS):
        now = stored(_small_star(_large_star(now).distinct()).distinct(), "links")
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == tuple(row):
            break
        state = tuple(row)
    else:
        raise RuntimeError(f"no end after {MAX_STEPS} steps")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()

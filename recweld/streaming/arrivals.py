"""Records as they arrive against a fixed left-hand side.

A stream of raw records is normalised, given its keys and joined with the static keys of the left-hand records. The join
needs no state; late records are matched like any other. Each micro-batch is written once per batch id, so that a batch
that is run again after a failure replaces its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import blocking as B
from ..plans.linkage import normalized


def key_column(records: DataFrame) -> DataFrame:
    """entity_id and the distinct keys of a normalised record that need no look at other records: name alone, skeleton alone,
    and words with localities."""
    word = F.filter(F.array_distinct(F.split("name_core", " ")), lambda w: F.length(w) >= 2)
    place = F.filter(F.split("addr_locality", r"[|]"), lambda x: x != "")
    local = F.flatten(F.transform(word, lambda w: F.transform(place, lambda x: F.concat_ws("|", F.col("country"), F.lit("tl"), w, x))))
    alone = F.array(F.when(F.length("name_nospace") >= 6, F.concat_ws("|", "country", F.lit("nm"), "name_nospace")), F.when(F.length("name_skel") >= 5, F.concat_ws("|", "country", F.lit("sk"), "name_skel")))
    keys = F.array_distinct(F.filter(F.concat(alone, local), lambda k: k.isNotNull()))
    return records.select("entity_id", F.explode(keys).alias("key"))


def arrival_candidates(arriving: DataFrame, left: DataFrame, cap: int = B.KEY_CAP) -> DataFrame:
    """A stream (or table) of (s1, s23, key) for raw arriving records, against normalised left-hand records."""
    static = B.within_cap(key_column(left).withColumnRenamed("entity_id", "s1"), cap)
    return key_column(normalized(arriving)).withColumnRenamed("entity_id", "s23").join(static, "key")


def write_arrivals(arriving: DataFrame, left: DataFrame, folder: str, checkpoint: str, cap: int = B.KEY_CAP, **trigger) -> StreamingQuery:
    """Starts the query: each micro-batch's pairs, with the number of keys shared, as Parquet under folder/batch=<id>."""

    def batch(found: DataFrame, batch_id: int) -> None:
        found.groupBy("s1", "s23").agg(F.count("*").alias("n_keys")).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return arrival_candidates(arriving, left, cap).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

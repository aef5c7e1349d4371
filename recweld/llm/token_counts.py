"""Exact token counts for every context limit, from one histogram of encoded lengths.

Every text is encoded whole with a byte-level BPE; each task returns (length, documents) for the lengths it saw, and one
small shuffle adds them up. Suffix sums over the histogram then answer, for each length L that occurs as the limit:
documents and tokens at or above it, the tokens left when each document is cut to L, and the share of documents at most
L long (the quantiles). Between two lengths that occur, all answers follow from the next one up: see answer().

The suffix sums are two-level: lengths are grouped into ranges of RANGE, ranges are summed first and their (few) totals
are added to the sums inside each range, so no task has to hold all lengths.

Nulls and empty texts have length 0; repeated rows count repeatedly. An empty table gives an empty histogram. Special
tokens' names in a text are ordinary text. Only the id and text columns are read, whatever other columns are called. The model file is a parameter; its bytes are broadcast, so that executors need no copy of it.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

MODEL_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokenisation pattern that belongs to the model file (a fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RANGE = 1024
#: The model file may be at most this large, as it is broadcast.
MODEL_BYTES_LIMIT = 64 << 20

_encoders: dict[int, object] = {}


def _encoder(model: bytes):
    key = hash(model)
    if key not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, model.splitlines())}
        _encoders[key] = tiktoken.Encoding("model", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def broadcast_file(spark: SparkSession, path: str):
    with open(path, "rb") as f:
        data = f.read(MODEL_BYTES_LIMIT + 1)
    if len(data) > MODEL_BYTES_LIMIT:
        raise ValueError(f"{path} is larger than {MODEL_BYTES_LIMIT} bytes")
    return spark.sparkContext.broadcast(data)


def token_lengths(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = MODEL_PATH) -> DataFrame:
    """One row per document row: its id and n_tokens."""
    model = broadcast_file(documents.sparkSession, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(model.value).encode_ordinary
        for batch in batches:
            lengths = [len(encode(t)) if (t := x.as_py()) else 0 for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths, pa.int64())], ["doc_id", "n_tokens"])

    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long")


def length_histogram(documents: DataFrame, text_col: str = "text", model_path: str = MODEL_PATH) -> DataFrame:
    """(n_tokens, n_docs) for every length that occurs. Texts are encoded once: the histogram is stored, as sums read it twice."""
    model = broadcast_file(documents.sparkSession, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(model.value).encode_ordinary
        seen: Counter[int] = Counter()
        for batch in batches:
            seen.update(len(encode(t)) if (t := x.as_py()) else 0 for x in batch.column("text"))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["n_tokens", "n_docs"])

    docs = documents.select(F.col(text_col).cast("string").alias("text"))
    return stored(docs.mapInArrow(run, "n_tokens long, n_docs long").groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")), "lengths")


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """The histogram with docs_at_least, tokens_at_least, tokens_truncated, share_at_most and the totals."""
    h = histogram.select("n_tokens", "n_docs", F.expr(f"n_tokens div {RANGE}").alias("part"))
    parts = h.groupBy("part").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    above = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    parts = parts.select("part", F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d_above"), F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t_above"), F.sum("d").over(every).alias("total_docs"), F.sum("t").over(every).alias("total_tokens"))
    inside = Window.partitionBy("part").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = h.join(parts, "part").withColumns({"docs_at_least": F.sum("n_docs").over(inside) + F.col("d_above"), "tokens_at_least": F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside) + F.col("t_above")})
    return sums.select(
        "n_tokens",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        (F.col("total_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("tokens_truncated"),
        ((F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("total_docs")).alias("share_at_most"),
        "total_docs",
        "total_tokens",
    )


def answer(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, docs_longer, tokens_truncated, tokens_lost) for any limits, whether or not they occur as a length."""
    spark = sums.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "context_limit long")
    totals = sums.select("total_docs", "total_tokens").limit(1)
    above = sums.select("n_tokens", "docs_at_least", "tokens_at_least").join(F.broadcast(asked), F.expr("n_tokens > context_limit"))
    first = above.groupBy("context_limit").agg(F.min_by(F.struct("docs_at_least", "tokens_at_least"), "n_tokens").alias("x"))
    out = asked.join(first, "context_limit", "left").join(F.broadcast(totals), F.lit(True), "left")
    lost = F.coalesce(F.expr("x.tokens_at_least - context_limit * x.docs_at_least"), F.lit(0))
    total = F.coalesce("total_tokens", F.lit(0))
    return out.select("context_limit", F.coalesce("x.docs_at_least", F.lit(0)).alias("docs_longer"), (total - lost).alias("tokens_truncated"), lost.alias("tokens_lost"))


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """One row: the smallest length that at least a share q of the documents do not exceed (null if there are none)."""
    return sums.where(F.col("share_at_most") >= q - 1e-12).agg(F.min("n_tokens").alias("n_tokens"))


def token_counts(documents: DataFrame, text_col: str = "text", model_path: str = MODEL_PATH) -> DataFrame:
    return suffix_sums(length_histogram(documents, text_col, model_path))

"""The corpus pipeline: stages over the documents table, each written as Parquet and read again as the next one's input.

1. language: documents whose language cannot be told (no letter, no text, or hardly better than by chance) go; the label is
   the predicted one where the prediction is sure or there was none. Without any labelled document, labels stay as they are.
2. near_duplicates: of each group of documents linked by n-gram Jaccard similarity, the one of the smallest id stays. Rows
   are told apart by id and text.
3. decontamination: documents that hold a passage of the benchmark go.
4. personal_data: spans of personal data are replaced by their kind.
5. pieces: documents become SentencePiece ids with their language and source, and a check of the round trip.

Each stage handles empty tables, nulls and repeated rows as its operator does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recweld.llm import language as language_id
from recweld.llm.common import stored, table
from recweld.llm.decontaminate import drop_contaminated
from recweld.llm.jaccard_join import deduplicate
from recweld.llm.pii import redact
from recweld.llm.sentencepiece import encode


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_known(docs, language_id.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode(docs, carry=("lang", "source"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("pieces", pieces)]
#: SQL can express neither the network nor the segmentation; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

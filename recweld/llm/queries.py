"""Queries over whole tables, one per operator (two of the join); SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import language, lm_score, quality
from .common import crc_bucket, table
from .decontaminate import decontaminate
from .jaccard_join import jaccard_components, jaccard_links
from .html_text import extract_text
from .media import media_digest
from .pii import pii_digest
from .sentencepiece import encode
from .token_counts import token_counts


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op1_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the class, whose number no other engine has."""
    return jaccard_links(table(spark, sf_dir, "documents")).drop("class")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_bucket("doc_id", 3) == 1
    model = language.train(docs.where(~held_out))
    return language.predict(docs, model, extra={"held_out": held_out})


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_bucket("doc_id", 7) == 2
    return lm_score.score(table(spark, sf_dir, "documents"), ~held_out, extra={"held_out": held_out})


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc_bucket("doc_id", 4) == 2
    model = quality.train(docs, labels.where(~held_out))
    return quality.score(docs, model, extra={"held_out": held_out})


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '{{}}')"

#: Distinct shingles of each document, pairs by their shared ones, links, and all that links reach. {{end}}: what is asked.
_JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("text", "[^\\x20\\x09-\\x0D]+")} AS ws FROM documents),
g AS (SELECT doc_id, ws, unnest(CASE WHEN len(ws) >= 5 THEN range(1, len(ws) - 3) WHEN len(ws) > 0 THEN [1] ELSE [] END) AS i FROM w),
s AS (SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(ws) >= 5 THEN ws[i:i + 4] ELSE ws END, ' ') AS sh FROM g),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.y FROM r JOIN l ON r.b = l.x)"""

_WINDOWS = f"""WITH d AS (SELECT doc_id, {_WORDS.format("text", "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")} AS ws FROM documents),
b AS (SELECT item_id, {_WORDS.format("text", "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")} AS ws FROM benchmark),
i AS (SELECT item_id, least(10, len(ws)) AS k, ws, unnest(range(1, greatest(len(ws) - 8, 2))) AS pos FROM b WHERE len(ws) > 0),
v AS (SELECT DISTINCT item_id, k, array_to_string(ws[pos:pos + k - 1], ' ') AS span FROM i),
q AS (SELECT doc_id, k, ws, unnest(range(1, greatest(len(ws) - k + 2, 1))) AS pos FROM d, (SELECT DISTINCT k FROM v)),
h AS (SELECT DISTINCT q.doc_id, q.k, q.pos, v.item_id FROM q JOIN v ON q.k = v.k AND array_to_string(q.ws[q.pos:q.pos + q.k - 1], ' ') = v.span),
hit AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(pos, pos + k)) FROM h) GROUP BY 1),
own AS (SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
SELECT d.doc_id, len(ws) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(own.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """Where ids are unique, as in the tables. The others need crc32, match positions, a parser, an image or a tokenizer."""
    return {
        "op1_jaccard_join": _JACCARD + " SELECT r.a AS doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.b) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a",
        "op1_jaccard_links": _JACCARD + """, t AS (SELECT doc_id, md5(string_agg(sh, chr(10) ORDER BY sh)) AS t FROM s GROUP BY doc_id), k AS (SELECT t.t AS own, count(DISTINCT u.t) AS n FROM l JOIN t ON t.doc_id = x JOIN t u ON u.doc_id = y WHERE u.t <> t.t GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(k.n, 0) AS n_links FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN k ON k.own = t.t""",
        "op8_decontamination": _WINDOWS,
    }

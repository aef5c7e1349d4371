"""Candidate generation: shared exact keys with caps, and two-sided nearest neighbours of vectors; union and recall.

Keys over the cap on either side are dropped whole, which bounds the pairs of a key by cap * cap; the drop is the
operator's meaning, not a way round skew. Vectors are compared exactly, in packed blocks: a block pair returns the k best
per vector only, so no pair table of all vectors is ever made.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.translit import transliterated

KEY_CAP = 50
FORWARD, REVERSE = 10, 2
MIN_COSINE = 0.05


def key_families(records: DataFrame, id_col: str = "entity_id") -> DataFrame:
    """(id, key) of normalised records, distinct: name and region (n), skeleton and region (s), words with house number and
    region (th), words with localities (tl), and name (nm) or skeleton (sk) alone. Every key begins with the country."""
    key = lambda kind, *parts: F.concat_ws("|", F.col("country"), F.lit(kind), *parts)
    have = lambda c: F.length(F.coalesce(F.col(c), F.lit(""))) > 0
    word = F.explode(F.filter(F.array_distinct(F.split("name_core", " ")), lambda w: F.length(w) >= 2)).alias("w")
    place = F.explode(F.filter(F.split("addr_locality", r"[|]"), lambda x: x != "")).alias("place")
    words = records.select("*", word)
    families = [
        records.where(have("name_nospace")).select(id_col, key("n", "name_nospace", "addr_region").alias("key")),
        records.where(have("name_skel")).select(id_col, key("s", "name_skel", "addr_region").alias("key")),
        words.where(have("addr_hnum")).select(id_col, key("th", "w", "addr_hnum", "addr_region").alias("key")),
        words.select("*", place).select(id_col, key("tl", "w", "place").alias("key")),
        records.where("length(name_nospace) >= 6").select(id_col, key("nm", "name_nospace").alias("key")),
        records.where("length(name_skel) >= 5").select(id_col, key("sk", "name_skel").alias("key")),
    ]
    return reduce(DataFrame.unionByName, families).dropna().distinct()


def within_cap(keys: DataFrame, cap: int = KEY_CAP) -> DataFrame:
    """The keys that at most cap rows have. Counted by partial sums, then joined back: no group is gathered in a task."""
    few = keys.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") <= cap)
    return keys.join(few.select("key"), "key", "left_semi")


def shared_key_pairs(left: DataFrame, right: DataFrame, cap: int = KEY_CAP) -> DataFrame:
    """left (s1, key), right (s23, key) -> (s1, s23, n_keys): how many keys within the cap they share."""
    joined = within_cap(left, cap).join(within_cap(right, cap), "key")
    return joined.groupBy("s1", "s23").agg(F.count("*").alias("n_keys"))


def baseline_key(name: str | Column) -> Column:
    """The baseline's key: transliterated letters and digits, all together."""
    return F.regexp_replace(transliterated(F.col(name) if isinstance(name, str) else name), "[^a-z0-9]", "")


def unique_key_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """The baseline: keys that one left-hand record of its country has, joined exactly. Columns key, country, s1 or s23.
    Keys are counted by partial sums; empty ones are left out."""
    own = left.where("key <> ''").groupBy("country", "key").agg(F.count("*").alias("_n"), F.min("s1").alias("s1")).where("_n = 1")
    return own.join(right, ["country", "key"]).select("s1", "s23")


def _blocks(vectors: DataFrame, id_name: str, rows: int) -> DataFrame:
    """Vectors (group, id, vector) packed in blocks: (group, block, ids, matrix). Group sizes are counted first, so that a
    large group has many blocks."""
    sizes = vectors.groupBy("group").agg(F.ceil(F.count("*") / rows).alias("_blocks"))
    dealt = vectors.join(sizes, "group").withColumn("block", F.pmod(F.xxhash64("id"), F.col("_blocks")))

    def pack(table: pa.Table) -> pa.Table:
        matrix = np.array(table["vector"].to_pylist(), np.float64)
        order = np.argsort(np.array(table["id"].to_pylist()), kind="stable")
        norm = np.linalg.norm(matrix, axis=1, keepdims=True)
        matrix = np.divide(matrix, norm, out=np.zeros_like(matrix), where=norm > 0)
        return pa.table({"group": table["group"][:1], "block": table["block"][:1], f"{id_name}_ids": [table["id"].take(pa.array(order)).to_pylist()], f"{id_name}_matrix": [matrix[order].tobytes()]})

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    return dealt.select("group", "block", "id", "vector").groupBy("group", "block").applyInArrow(pack, f"group {kinds['group']}, block long, {id_name}_ids array<{kinds['id']}>, {id_name}_matrix binary")


def _block_pairs(left: DataFrame, right: DataFrame, block_rows: int) -> DataFrame:
    """Every block of a group's left-hand vectors with every one of its right-hand ones. Blocks are sent to the tile that
    they meet in, so that the tiles of one group are spread over all tasks."""
    a, b = (_blocks(df, n, block_rows).withColumnRenamed("block", f"{n}_block") for df, n in ((left, "a"), (right, "b")))
    sizes = [df.groupBy("group").agg(F.ceil(F.count("*") / block_rows).alias(f"{n}_blocks")) for df, n in ((left, "a"), (right, "b"))]
    a = a.join(sizes[1], "group").withColumn("b_block", F.explode(F.sequence(F.lit(0), F.col("b_blocks") - 1))).drop("b_blocks")
    b = b.join(sizes[0], "group").withColumn("a_block", F.explode(F.sequence(F.lit(0), F.col("a_blocks") - 1))).drop("a_blocks")
    return a.join(b, ["group", "a_block", "b_block"])


def _tiles(batch: pa.RecordBatch) -> Iterator[tuple[list, list, np.ndarray]]:
    """Ids of both sides and their cosines, tile by tile."""
    for row in range(batch.num_rows):
        a, b = (batch.column(f"{x}_ids")[row].as_py() for x in "ab")
        x, y = (np.frombuffer(batch.column(f"{n}_matrix")[row].as_py()).reshape(len(ids), -1) for n, ids in (("a", a), ("b", b)))
        yield a, b, x @ y.T


def nearest_both_ways(left: DataFrame, right: DataFrame, forward: int = FORWARD, reverse: int = REVERSE, digits: int | None = 6, block_rows: int = 2048, min_cosine: float = MIN_COSINE) -> DataFrame:
    """Exact cosine neighbours within a group: the best `forward` of each left-hand vector and the best `reverse` of each
    right-hand one. Columns s1, s23, cos, rank_fwd, rank_rev (NULL where it is not among the best). Ties: smaller id first.
    left and right: (group, id, vector). Vectors without length have cosine 0."""
    id_type = left.schema["id"].dataType.simpleString()
    pairs = _block_pairs(left, right, block_rows)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [batch.schema.field(f"{n}_ids").type.value_type for n in "ab"]
            for a, b, cosine in _tiles(batch):
                if digits is not None:
                    cosine = np.round(cosine, digits)
                keep = np.zeros(cosine.shape, bool)
                for k, matrix, mask in ((forward, cosine, keep), (reverse, cosine.T, keep.T)):
                    order = np.argsort(-matrix, axis=1, kind="stable")[:, :k]
                    np.put_along_axis(mask, order, True, axis=1)
                i, j = np.nonzero(keep & (cosine > min_cosine))
                yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in i], kinds[0]), pa.array([b[k] for k in j], kinds[1]), pa.array(cosine[i, j], pa.float64())], ["s1", "s23", "cos"])

    near = pairs.select("a_ids", "a_matrix", "b_ids", "b_matrix").mapInArrow(best, f"s1 {id_type}, s23 {id_type}, cos double")
    fwd = F.row_number().over(Window.partitionBy("s1").orderBy(F.desc("cos"), "s23"))
    rev = F.row_number().over(Window.partitionBy("s23").orderBy(F.desc("cos"), "s1"))
    ranked = near.withColumn("f", fwd).withColumn("r", rev).where((F.col("f") <= forward) | (F.col("r") <= reverse))
    return ranked.select("s1", "s23", "cos", F.when(F.col("f") <= forward, F.col("f")).cast("long").alias("rank_fwd"), F.when(F.col("r") <= reverse, F.col("r")).cast("long").alias("rank_rev"))


def pairs_above(left: DataFrame, right: DataFrame, cosine: float, digits: int = 6, block_rows: int = 2048) -> DataFrame:
    """(s1, s23) of all pairs of a group with a greater cosine: only these leave a tile."""
    id_type = left.schema["id"].dataType.simpleString()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [batch.schema.field(f"{n}_ids").type.value_type for n in "ab"]
            for a, b, own in _tiles(batch):
                i, j = np.nonzero(np.round(own, digits) > cosine)
                yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in i], kinds[0]), pa.array([b[k] for k in j], kinds[1])], ["s1", "s23"])

    return _block_pairs(left, right, block_rows).select("a_ids", "a_matrix", "b_ids", "b_matrix").mapInArrow(found, f"s1 {id_type}, s23 {id_type}")


def merge_directions(found: DataFrame) -> DataFrame:
    """One row per pair found in several searches: its best cosine and ranks."""
    return found.groupBy("s1", "s23").agg(F.max("cos").alias("cos"), F.min("rank_fwd").alias("rank_fwd"), F.min("rank_rev").alias("rank_rev"))


def union_candidates(by_key: DataFrame, by_vector: DataFrame, forward: int = FORWARD) -> DataFrame:
    """All pairs of both ways: n_keys and cos are 0 where a way did not find them. Of pairs found forward only, the first
    `forward` stay."""
    both = by_key.join(by_vector, ["s1", "s23"], "full")
    kept = both.where((F.coalesce("rank_fwd", F.lit(999)) <= forward) | F.col("rank_rev").isNotNull() | (F.coalesce("n_keys", F.lit(0)) > 0))
    return kept.select("s1", "s23", F.coalesce("n_keys", F.lit(0)).alias("n_keys"), F.coalesce("cos", F.lit(0.0)).alias("cos"), "rank_fwd", "rank_rev")


def recall(truth: DataFrame, candidates: DataFrame, channels: dict[str, Column]) -> DataFrame:
    """(channel, pairs, found, recall, entity_recall) of true pairs; entity recall: records with all partners found."""
    hits = truth.join(candidates.withColumn("_hit", F.lit(True)), ["s1", "s23"], "left")
    flags = {name: F.coalesce(F.col("_hit") & own, F.lit(False)).cast("long") for name, own in channels.items()}
    rows = hits.select("s1", F.explode(F.array(*[F.struct(F.lit(n).alias("channel"), x.alias("hit")) for n, x in flags.items()])).alias("x")).select("s1", "x.*")
    each = rows.groupBy("channel", "s1").agg(F.count("*").alias("n"), F.sum("hit").alias("hit"))
    return each.groupBy("channel").agg(F.sum("n").alias("pairs"), F.sum("hit").alias("found"), (F.sum("hit") / F.sum("n")).alias("recall"), F.avg((F.col("hit") == F.col("n")).cast("double")).alias("entity_recall"))


# --- weighted words and character grams -------------------------------------------------------------------------------


def char_grams(c: Column, n: int = 3) -> Column:
    """All n-grams inside each word with a space on either side."""
    grams = lambda w: F.when(F.length(w) + 2 >= n, F.transform(F.sequence(F.lit(1), F.length(w) + 3 - n), lambda i: F.substring(F.concat(F.lit(" "), w, F.lit(" ")), i, n)))
    return F.flatten(F.transform(F.filter(F.split(c, " "), lambda w: w != ""), grams))


def tfidf(terms: DataFrame, part: str | None = None) -> DataFrame:
    """(id, term) with repeats -> (id, term, w): (1 + ln tf) * (ln((1 + N) / (1 + df)) + 1), rows of length one. part: a column
    of kinds of terms, each weighted by itself."""
    by = [part] if part else []
    tf = terms.groupBy(*by, "id", "term").agg(F.count("*").alias("tf"))
    n = tf.groupBy(*by).agg(F.count_distinct("id").alias("n_docs"))
    df = tf.groupBy(*by, "term").agg(F.count("*").alias("df"))
    both = tf.join(df, [*by, "term"])
    w = (both.join(F.broadcast(n), part) if part else both.join(F.broadcast(n))).select(*by, "id", "term", ((1 + F.ln("tf")) * (F.ln((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1)).alias("w"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*by, "id")))
    return w.select(*by, "id", "term", (F.col("w") / length).alias("w"))


def pair_cosines(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Cosines of given pairs (s1, s23) from weights (id, term, w) of both sides; 0 without a common term."""
    a = left.select(F.col("id").alias("s1"), "term", F.col("w").alias("w1"))
    b = right.select(F.col("id").alias("s23"), "term", F.col("w").alias("w2"))
    dots = pairs.join(a, "s1").join(b, ["s23", "term"]).groupBy("s1", "s23").agg(F.sum(F.col("w1") * F.col("w2")).alias("cos"))
    return pairs.join(dots, ["s1", "s23"], "left").withColumn("cos", F.coalesce("cos", F.lit(0.0)))


def idf(terms: DataFrame) -> DataFrame:
    """(id, term) -> (term, df, idf): ln((1 + N) / (1 + df)) + 1 over distinct words of a record."""
    n = terms.agg(F.count_distinct("id").alias("n_docs"))
    df = terms.distinct().groupBy("term").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(n)).select("term", "df", (F.ln((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))


def _gaussians(h: np.ndarray, dims: int, seed: int) -> np.ndarray:
    """Normal numbers drawn from the hashes: len(h) x dims, the same wherever they are made (Box and Muller)."""
    half = -(-dims // 2)
    z = h.astype(np.uint64)[:, None] + np.arange(1, 2 * half + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2**53
    radius, angle = np.sqrt(-2 * np.log(np.maximum(u[:, :half], 1e-300))), 2 * np.pi * u[:, half:]
    return np.concatenate([radius * np.cos(angle), radius * np.sin(angle)], axis=1)[:, :dims].astype(np.float32)


def projected_vectors(weights: DataFrame, dims: int, seed: int = 0, length: float | None = None) -> DataFrame:
    """(id, term, w) -> (id, vector): a Gaussian random projection whose entries are drawn from a hash of term and dimension,
    so that no matrix is kept and weighted parts of a record add up. A record's terms are summed up where they are: what is
    shuffled are terms and weights, and one vector leaves a task for each record. length: what vectors are scaled to (those of
    zeros stay)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                own = part.column("terms")
                flat, sizes = own.flatten(), np.diff(own.offsets.to_numpy())
                h, at = np.unique(flat.field("h").to_numpy(), return_inverse=True)
                normal, w = _gaussians(h.view(np.uint64), dims, seed), flat.field("w").to_numpy().astype(np.float32)
                out, ends = np.zeros((len(sizes), dims), np.float32), np.concatenate([[0], np.cumsum(sizes)])
                for a in range(0, len(sizes), 64):  # few records at once: their terms' rows stay in the cache
                    low, high = ends[a], ends[min(len(sizes), a + 64)]
                    if high > low:
                        out[a : a + 64] = np.add.reduceat(normal[at[low:high]] * w[low:high, None], ends[a : min(len(sizes), a + 64)] - low, axis=0)
                out = out.astype(np.float64) / np.sqrt(dims)
                if length is not None:
                    norm = np.linalg.norm(out, axis=1, keepdims=True)
                    out = np.divide(out * length, norm, out=np.zeros_like(out), where=norm > 0)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * dims, pa.int32()), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("id"), vectors], ["id", "vector"])

    kind = weights.schema["id"].dataType.simpleString()
    terms = weights.groupBy("id").agg(F.collect_list(F.struct(F.xxhash64("term").alias("h"), F.col("w").cast("double").alias("w"))).alias("terms"))
    return terms.mapInArrow(run, f"id {kind}, vector array<double>")

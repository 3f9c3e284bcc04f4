"""Hard negatives by an exact inner-product search over candidates in order of their norm.

1. Rows are dealt to key ranges by norm, largest first, and lie in that order in a table: its files are ranges of norms,
   and parts of ``BUCKET`` rows inside them are the buckets. Equal norms are told apart by id, so copies spread.
2. Anchors come in blocks of bounded size, which are sent to all tasks. Each task goes through its buckets; by Cauchy
   and Schwarz no score of a bucket exceeds the anchor's norm times the bucket's largest one. Buckets below what an
   anchor still wants are left out, and as norms only fall, so is all that follows once no anchor wants any.
3. Positives: an anchor wants scores that reach its kth best so far. Negatives: each (anchor, positive) has a window
   of scores around shares of the positive's; it wants scores that reach the window's lower limit and its kth best so far.
   The least norm that any window wants also goes to the scan as a filter, which skips whole files and row groups.
4. The best of all tasks meet per anchor, then per window.

Vectors hold integers and scores are exact: in doubles while no score can reach 2^53, else in 64-bit integers; where a
score could leave these, the job fails. Nothing is left out but what the bound excludes, so results equal a full search.

Defined cases: rows whose id, label or vector is null, or whose vector has no component, null or non-finite ones, or
another length than the most frequent, take no part; rows equal in id, label and vector count once, others with equal
ids are rows of their own, though no row is a positive or negative of its own id; ties go to the smaller id; a window
whose positive has a negative score is empty; anchors without positives give no rows; an empty table gives none; other
columns, whatever their names, are ignored; a vector of any length is compared whole.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Rows of a bucket, and anchors or windows compared with it at once: they bound memory and change no result.
BUCKET, AT_ONCE = 2048, 1024
#: Bytes of the anchors' vectors in a block, as 64-bit numbers.
BLOCK_BYTES = 16_000_000
#: Norms are computed in doubles; the bound is widened by this share.
SLACK = 1e-9


def integers(embedding: Column, scale: int = 256) -> Column:
    """Each component x as floor(scale * x), x as a double."""
    return F.transform(embedding, lambda x: F.floor(F.lit(scale) * x.cast("double")))


def vectors_of(lists: pa.Array, dim: int, exact: type) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).astype(exact).reshape(-1, dim)


class Best:
    """The k best rows per slot met so far: higher scores first, then smaller ids."""

    def __init__(self, slots: int, k: int):
        self.k, self.slot, self.score, self.id = k, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.kth = np.full(slots, np.iinfo(np.int64).min)

    def add(self, slots: np.ndarray, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
        """scores[i, j]: of row ids[j] for slots[i], where allowed."""
        allowed &= scores >= self.kth[slots][:, None]
        if scores.shape[1] > self.k:
            shown = np.where(allowed, scores, -np.inf if scores.dtype.kind == "f" else np.iinfo(np.int64).min)
            allowed &= shown >= np.partition(shown, -self.k, axis=1)[:, -self.k, None]
        i, j = np.nonzero(allowed)
        if not len(i):
            return
        slot, score, found = np.append(self.slot, slots[i]), np.append(self.score, scores[i, j].astype(np.int64)), np.append(self.id, ids[j])
        order = np.lexsort((found, -score, slot))
        slot, score, found = slot[order], score[order], found[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        keep = place < self.k
        self.slot, self.score, self.id, place = slot[keep], score[keep], found[keep], place[keep]
        last = place == self.k - 1
        self.kth[self.slot[last]] = self.score[last]


def buckets(it: Iterator[pa.RecordBatch], dim: int, exact: type):
    """ids, labels, vectors and the largest norm of each bucket."""
    for batch in it:
        for at in range(0, batch.num_rows, BUCKET):
            b = batch.slice(at, BUCKET)
            yield b.column("vec_id").to_numpy(), b.column("label").to_numpy(), vectors_of(b.column("vector"), dim, exact), b.column("norm").to_numpy().max() * (1 + SLACK)


class Search:
    """A block of anchors (ids, labels, vectors, norms) against all rows."""

    def __init__(self, rows: DataFrame, ids, labels, vectors: np.ndarray, norms: np.ndarray):
        self.rows, self.ids, self.labels, self.vectors, self.norms = rows, ids, labels, vectors, norms

    def positives(self, k: int) -> DataFrame:
        """anchor (its place in the block), id, score: the k best rows of the anchor's label that each task has met."""
        ids, labels, vectors, norms = self.ids, self.labels, self.vectors, self.norms

        def met(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(len(ids), k)
            for row_ids, row_labels, row_vectors, norm in buckets(it, vectors.shape[1], vectors.dtype.type):
                wanting = np.flatnonzero(norms * norm >= best.kth)
                if not len(wanting):
                    continue
                for label in np.unique(row_labels):
                    these, those = wanting[labels[wanting] == label], row_labels == label
                    for at in range(0, len(these), AT_ONCE):
                        some = these[at : at + AT_ONCE]
                        best.add(some, vectors[some] @ row_vectors[those].T, ids[some][:, None] != row_ids[those], row_ids[those])
            yield pa.RecordBatch.from_arrays([pa.array(best.slot), pa.array(best.id), pa.array(best.score)], ["slot", "id", "score"])

        return self.rows.mapInArrow(met, "slot long, id long, score long")

    def negatives(self, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> DataFrame:
        """window, id, score: the k best rows of other labels within the windows that each task has met; anchor: the windows' anchors."""
        ids, labels, vectors, norms = self.ids, self.labels, self.vectors, self.norms

        def met(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(len(anchor), k)
            for row_ids, row_labels, row_vectors, norm in buckets(it, vectors.shape[1], vectors.dtype.type):
                wanting = np.flatnonzero(norms[anchor] * norm >= np.maximum(low, best.kth))
                for at in range(0, len(wanting), AT_ONCE):
                    some = wanting[at : at + AT_ONCE]
                    asked, place = np.unique(anchor[some], return_inverse=True)
                    scores = (vectors[asked] @ row_vectors.T)[place]
                    allowed = (low[some, None] <= scores) & (scores <= high[some, None]) & (labels[anchor[some], None] != row_labels) & (ids[anchor[some], None] != row_ids)
                    best.add(some, scores, allowed, row_ids)
            yield pa.RecordBatch.from_arrays([pa.array(best.slot), pa.array(best.id), pa.array(best.score)], ["slot", "id", "score"])

        least = float((np.maximum(low, 0) / np.maximum(norms[anchor], 1e-300)).min()) * (1 - SLACK)
        return self.rows.where(F.col("norm") >= F.lit(least)).mapInArrow(met, "slot long, id long, score long")


def first(found: DataFrame, k: int) -> DataFrame:
    """rank, and only the k best per slot."""
    place = F.row_number().over(common.window("slot", F.desc("score"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def in_norm_order(vectors: DataFrame) -> DataFrame | None:
    """vec_id, label, vector -> the rows that take part with their norm, written in its order; None if there are none."""
    v = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "vector").where("vec_id IS NOT NULL AND label IS NOT NULL AND size(vector) > 0 AND forall(vector, x -> x IS NOT NULL)")
    length = v.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if length is None:
        return None
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    v = v.where(F.size("vector") == length["dim"]).distinct().withColumn("norm", norm)
    return common.written(v.repartitionByRange(F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id"))


def mined(vectors: DataFrame, is_anchor: str, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """vectors: vec_id, label, vector (integers). is_anchor: a condition on vec_id. low, high: the window in hundredths of the
    positive's score. Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = vectors.sparkSession
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = in_norm_order(vectors)
    if rows is None:
        return spark.createDataFrame([], out)
    anchors = rows.where(is_anchor)
    most, n, longest = rows.agg(F.max("norm"), F.count_if(F.expr(is_anchor)), F.max(F.when(F.expr(is_anchor), F.col("norm")))).first()
    if not n:
        return spark.createDataFrame([], out)
    largest = most * longest * (1 + SLACK)
    if largest >= 2**63:
        raise ValueError(f"scores may reach {largest:.3g}, beyond 64-bit integers")
    exact = np.float64 if largest < 2**53 else np.int64
    dim = len(anchors.select("vector").first()[0])
    blocks = -(-n * dim * 8 // block_bytes)
    found = []
    for block in range(blocks):
        here = anchors.where(F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks)) == block).toArrow()
        search = Search(rows, here["vec_id"].to_numpy(), here["label"].to_numpy(), vectors_of(here["vector"], dim, exact), here["norm"].to_numpy())
        near = first(search.positives(positives), positives).toArrow()  # that many rows per anchor of the block
        anchor, positive, score = near["slot"].to_numpy(), near["id"].to_numpy(), near["score"].to_numpy()
        lower, upper = (np.array(a, np.int64) for a in ([-(-low * s // 100) for s in score.tolist()], [high * s // 100 for s in score.tolist()]))  # Python's integers don't overflow
        open_ = lower <= upper
        if not open_.any():
            continue
        anchor, positive, score, lower, upper = (a[open_] for a in (anchor, positive, score, lower, upper))
        hard = first(search.negatives(anchor, lower, upper, negatives), negatives)
        found.append(common.written(named(hard, search.ids[anchor], positive, score)))
    if not found:
        return spark.createDataFrame([], out)
    return functools.reduce(DataFrame.unionByName, found)


def named(hard: DataFrame, anchor_ids: np.ndarray, positive_ids: np.ndarray, positive_scores: np.ndarray) -> DataFrame:
    """The windows' numbers replaced by what they stand for."""
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            slot = b.column("slot").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(anchor_ids[slot]), pa.array(positive_ids[slot]), b.column("rank").cast("int32"), b.column("id"), pa.array(positive_scores[slot]), b.column("score")], names)

    return hard.mapInArrow(batches, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def quantised(embeddings: DataFrame) -> DataFrame:
    """Labels as the query has them, components as integers; rows with null or non-finite components go."""
    finite = "x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')"
    label = F.expr("IF(vec_id % 7 = 0, (label + 1) % 10, label)")
    return embeddings.where(f"embedding IS NOT NULL AND forall(embedding, {finite})").select("vec_id", label.alias("label"), integers(F.col("embedding")).alias("vector"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined(quantised(common.table(spark, sf_dir, "embeddings")), "vec_id % 100 = 0")


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    list_sum(list_transform(list_zip(a.q, b.q), lambda x: x[1] * x[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""

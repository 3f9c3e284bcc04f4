"""Ranked lexical search: MaxScore over the postings of shards.

1. The items' distinct terms make the vocabulary; items come in blocks with a bounded number of terms.
2. One pass over the documents counts each text's terms and leaves the vocabulary's, as numbers with their
   occurrences: a table of postings by document, far smaller than the texts. A corpus' counts (documents, terms, documents that
   hold a term) come from it by grouping.
3. A task turns its documents, a bounded number of postings at a time, into a shard: lists of (document, share of the score)
   per term, each with its largest share.
4. Each item is scored per shard, its terms in order of their largest shares. As long as the shares still to come
   reach the item's kth score so far, all documents of a list are candidates (essential lists); once they don't,
   the rest is probed only for candidates that can still qualify (non-essential lists), and these become fewer with
   each list. The kth scores go on from shard to shard within a task.
5. The best of all tasks meet per item.

Nothing is left out but what the bounds exclude, so results equal a full scoring.

Defined cases: null texts, and texts without a term, hold nothing and don't count among the documents; items with equal
ids are one item with the terms of all; items without terms have no results; null ids of items are one more item, null
ids of documents come last among ties; repeated documents are documents of their own; an empty table on either side
gives no rows; very long texts are counted piece by piece between terms; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Terms of the items in a block; postings of a shard; bytes of a text whose terms are held at once.
#: They bound memory and change no result.
BLOCK_TERMS, SHARD_POSTINGS, PIECE = 500_000, 2_000_000, 1_000_000
#: A row without id sorts after all others.
LAST = np.iinfo(np.int64).max
#: Bytes of UTF-8 that are part of a term; all others become spaces.
TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms_of(text: Column) -> Column:
    """The distinct terms of a text, A-Z lower-cased."""
    return F.array_distinct(F.filter(F.split(common.ascii_lower(text), SEPARATORS), lambda t: t != ""))


def counted(text: str | None) -> Counter:
    """The terms of a whole text, as bytes, with their occurrences."""
    counts: Counter = Counter()
    if text:
        content = text.encode("utf-8", "surrogatepass").lower().translate(TERM_BYTES)
        at = 0
        while at < len(content):
            upto = content.find(b" ", at + PIECE) if len(content) - at > PIECE else -1
            upto = len(content) if upto < 0 else upto
            counts.update(content[at:upto].split())
            at = upto
    return counts


def postings(docs: DataFrame, vocabulary: list[str], text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n (its terms with repeats), terms (numbers in the vocabulary), tf: one row per document with a term."""
    number = {t.encode(): i for i, t in enumerate(vocabulary)}

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids, n, terms, tf = [], [], [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if counts := counted(text):
                    ids.append(i)
                    n.append(counts.total())
                    held = [(number[t], c) for t, c in counts.items() if t in number]
                    terms.append([t for t, _ in held])
                    tf.append([c for _, c in held])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "tf"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return common.in_batches(texts, batches, "doc_id long, n long, terms array<int>, tf array<long>")


def weights(df: dict[int, int], terms: int, documents: int) -> np.ndarray:
    """Of each term; 0 if no document holds it."""
    out = np.zeros(terms, np.int64)
    for term, n in df.items():
        out[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1)))
    return out


def lengths(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """m of each document; Python's integers where 64 bits don't do."""
    if not len(n) or 50 * int(n.max()) * documents < 2**63:
        return 50 + 50 * n * documents // max(total, 1)
    return np.array([50 + 50 * i * documents // total for i in n.tolist()], np.int64)


class Shard:
    """Postings by term: documents' places and the shares that their occurrences add to a score."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tf: np.ndarray, weight: np.ndarray, documents: int, total: int):
        self.ids = ids
        place = np.repeat(np.arange(len(ids)), sizes)
        share = weight[terms] * (1_000_000_000 * tf // (1000 * tf + 20 * lengths(n, documents, total)[place]))
        order = np.lexsort((place, terms))
        self.place, self.share = place[order], share[order]
        self.terms, starts = np.unique(terms[order], return_index=True)
        self.starts = np.append(starts, len(order))
        self.most = np.maximum.reduceat(self.share, starts) if len(starts) else starts
        self.at = {t: i for i, t in enumerate(self.terms.tolist())}

    def best(self, terms: list[int], k: int, kth: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of documents that may be among the k best of all; kth: a score that k others reach already."""
        lists = sorted((i for t in terms if (i := self.at.get(t)) is not None), key=lambda i: -self.most[i])
        to_come = np.append(np.cumsum(self.most[lists][::-1])[::-1], 0) if lists else np.zeros(1, np.int64)
        scores = np.zeros(len(self.ids), np.int64)
        candidates = None  # all that a list has touched
        for i, which in enumerate(lists):
            place, share = self.place[self.starts[which] : self.starts[which + 1]], self.share[self.starts[which] : self.starts[which + 1]]
            if candidates is None and to_come[i] < kth:
                candidates = np.flatnonzero(scores)
            if candidates is None:  # an essential list
                scores[place] += share
                if len(place) >= k:
                    kth = max(kth, int(np.partition(scores[place], -k)[-k]))
                continue
            # a non-essential list: probed for documents that may still reach the kth score
            candidates = candidates[scores[candidates] + to_come[i] >= kth]
            if not len(candidates):
                break
            found = np.searchsorted(place, candidates)
            found[found == len(place)] = 0
            hit = place[found] == candidates
            scores[candidates[hit]] += share[found[hit]]
            if len(candidates) >= k:
                kth = max(kth, int(np.partition(scores[candidates], -k)[-k]))
        candidates = np.flatnonzero(scores) if candidates is None else candidates
        candidates = candidates[scores[candidates] >= max(kth, 1)]
        return candidates, scores[candidates]


def leading(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest scores first, then smallest ids."""
    return np.lexsort((ids, -scores))[:k]


def shards(it: Iterator[pa.RecordBatch], make) -> Iterator[Shard]:
    """Batches of postings put together up to SHARD_POSTINGS."""
    held, size = [], 0
    for b in it:
        held.append(b)
        size += b.num_rows + len(b.column("terms").values)
        if size >= SHARD_POSTINGS:
            yield make(pa.Table.from_batches(held).combine_chunks())
            held, size = [], 0
    if held:
        yield make(pa.Table.from_batches(held).combine_chunks())


def scored(posted: DataFrame, items: list[list[int]], weight: np.ndarray, documents: int, total: int, k: int) -> DataFrame:
    """item (its place), doc_id, score: the k best that each task has met."""

    def make(t: pa.Table) -> Shard:
        ids, n, terms, tf = (t[c].combine_chunks() if t.num_rows else pa.array([], t.schema.field(c).type) for c in ("doc_id", "n", "terms", "tf"))
        sizes = np.diff(terms.offsets.to_numpy())
        return Shard(ids.fill_null(LAST).to_numpy(), n.to_numpy(), sizes, terms.flatten().to_numpy(), tf.flatten().to_numpy(), weight, documents, total)

    def met(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(items)
        for shard in shards(it, make):
            for i, terms in enumerate(items):
                ids, scores = best[i]
                place, new = shard.best(terms, k, int(scores[-1]) if len(scores) == k else 0)
                if len(place):
                    ids, scores = np.append(ids, shard.ids[place]), np.append(scores, new)
                    lead = leading(ids, scores, k)
                    best[i] = ids[lead], scores[lead]
        for i, (ids, scores) in enumerate(best):
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), i, np.int32)), pa.array(ids, mask=ids == LAST), pa.array(scores)], ["item", "doc_id", "score"])

    return posted.mapInArrow(met, "item int, doc_id long, score long")


def in_blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """(item_id, terms) in blocks with a bounded number of terms, or one item."""
    block, size = [], 0
    for row in items.toLocalIterator():
        if block and size + len(row["terms"]) > BLOCK_TERMS:
            yield block
            block, size = [], 0
        block.append((row["item_id"], row["terms"]))
        size += len(row["terms"])
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """docs: doc_id, text; items: item_id, text. Returns item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    asked = items.select(F.col("item_id").cast("long"), F.explode(terms_of(F.col("text").cast("string"))).alias("term")).groupBy("item_id").agg(F.sort_array(F.collect_set("term")).alias("terms"))
    found = []
    for block in in_blocks(common.written(asked)):
        vocabulary = sorted({t for _, terms in block for t in terms})
        number = {t: i for i, t in enumerate(vocabulary)}
        posted = common.written(postings(docs, vocabulary))
        documents, total = posted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        holding = posted.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()  # one row per term of the block
        weight = weights(dict(zip(holding["term"].to_pylist(), holding["count"].to_pylist())), len(vocabulary), documents)
        best = scored(posted, [[number[t] for t in terms] for _, terms in block], weight, documents, total, k)
        place = F.row_number().over(common.window("item", F.desc("score"), F.col("doc_id").asc_nulls_last()))
        best = best.withColumn("rank", place).where(F.col("rank") <= k)
        ids = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", T.LongType())]))
        found.append(common.written(best.join(F.broadcast(ids), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")))
        common.forget(posted)
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return functools.reduce(DataFrame.unionByName, found)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH t AS (
  SELECT row_id, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS row_id, doc_id, text FROM documents)),
n AS (SELECT row_id, count(*) AS n FROM t GROUP BY row_id),
c AS (SELECT count(*) AS documents, sum(n)::BIGINT AS total FROM n),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
p AS (SELECT row_id, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY row_id, term),
w AS (SELECT term, floor(1000 * ln((2 * documents + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY term, documents),
s AS (
  SELECT item_id, row_id, any_value(doc_id) AS doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * documents) // total))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN n USING (row_id), c GROUP BY item_id, row_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 50
"""

"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

1. Equal vectors become one class with its k + 1 smallest ids (more can't appear among k nearest, as
   ties go to smaller ids), so copies cost nothing, however many there are.
2. The tree is fitted on the driver on a bounded sample (the ``sample`` classes with the smallest hash
   of their id); every class is then dealt to a leaf, and leaves are cut into blocks of bounded size.
3. A query walks the tree with a priority queue of nodes by distance to their centre, taking leaves
   until it has visited as many as calibration asks for (and enough rows for k answers).
4. Calibration: for a bounded set of queries the exact neighbours are found by brute force over all
   classes; leaf visits widen until recall over these reaches the target.
5. (leaf block, query block) groups compute their distances; each query's best of each group meet.

Nearness is Euclidean distance in double precision; the score is computed from the differences.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do
null ids, nor vectors of another length than the most frequent; components may be floats, doubles or integers; rows with equal id and vector count
once; with fewer than k candidates all are returned; an empty table gives no rows; other columns, whatever their
names, are ignored; a vector of any length is compared whole.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Classes to fit the tree on, classes per leaf to aim at, children per node, queries to calibrate on,
#: and the recall that these must reach.
SAMPLE, LEAF_ROWS, FANOUT, CALIBRATE, RECALL = 20_000, 150, 8, 200, 0.97
#: Rows and queries of a group: its distance matrix has as many entries at most on average.
BLOCK_ROWS, BLOCK_QUERIES = 4096, 1024


class Tree:
    """centres[node]; children[node]: first child and their number; leaf[node]: leaf number or -1."""

    def __init__(self, points: np.ndarray, leaf_points: int, fanout: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.centres, self.children, self.leaf, self.leaves = [points.mean(0) if len(points) else np.zeros(1)], [(0, 0)], [-1], 0
        queue = [(0, points)]
        for node, mine in queue:
            parts = self.split(mine, fanout, rng) if len(mine) > leaf_points else []
            if len(parts) < 2:
                self.leaf[node] = self.leaves
                self.leaves += 1
                continue
            self.children[node] = len(self.centres), len(parts)
            for centre, part in parts:
                self.centres.append(centre)
                self.children.append((0, 0))
                self.leaf.append(-1)
                queue.append((len(self.centres) - 1, part))
        self.centres = np.array(self.centres)

    @staticmethod
    def split(points: np.ndarray, fanout: int, rng) -> list[tuple[np.ndarray, np.ndarray]]:
        centres = points[rng.choice(len(points), min(fanout, len(points)), replace=False)]
        for _ in range(8):
            nearest = ((centres**2).sum(1)[None] - 2 * points @ centres.T).argmin(1)
            centres = np.array([points[nearest == c].mean(0) if (nearest == c).any() else centres[c] for c in range(len(centres))])
        nearest = ((centres**2).sum(1)[None] - 2 * points @ centres.T).argmin(1)
        return [(centres[c], points[nearest == c]) for c in range(len(centres)) if (nearest == c).any()]

    def assign(self, points: np.ndarray) -> np.ndarray:
        """Each point's leaf: down the tree to the nearest child."""
        out, queue = np.zeros(len(points), np.int32), [(0, np.arange(len(points)))]
        for node, mine in queue:
            first, n = self.children[node]
            if not n:
                out[mine] = self.leaf[node]
                continue
            centres = self.centres[first : first + n]
            nearest = ((centres**2).sum(1)[None] - 2 * points[mine] @ centres.T).argmin(1)
            queue += [(first + c, mine[nearest == c]) for c in range(n) if (nearest == c).any()]
        return out

    def best_bins(self, query: np.ndarray) -> Iterator[int]:
        """Leaves, best first: always the nearest node in the queue is opened next."""
        heap = [(0.0, 0)]
        while heap:
            _, node = heapq.heappop(heap)
            first, n = self.children[node]
            if not n:
                yield self.leaf[node]
                continue
            d = ((self.centres[first : first + n] - query) ** 2).sum(1)
            for c in range(n):
                heapq.heappush(heap, (float(d[c]), first + c))


def matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim) if len(column) else np.empty((0, dim))


def nearest(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query the k nearest rows: query numbers, ids and exact distances."""
    if not len(queries) or not len(rows):
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    rough = (queries**2).sum(1)[:, None] + (rows**2).sum(1)[None] - 2 * queries @ rows.T
    slack = 1e-9 * (1 + (queries**2).sum(1).max() + (rows**2).sum(1).max())
    if len(rows) > k:
        q, r = np.nonzero(rough <= np.partition(rough, k - 1, axis=1)[:, k - 1 : k] + slack)
    else:
        q, r = np.nonzero(np.ones_like(rough, dtype=bool))
    exact = np.sqrt(((queries[q] - rows[r]) ** 2).sum(1))
    order = np.lexsort((ids[r], exact, q))
    q, r, exact = q[order], r[order], exact[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)  # within its query
    return q[place < k], ids[r[place < k]], exact[place < k]


def best(found: DataFrame, by: str, k: int) -> DataFrame:
    return found.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("score", "cid"))).where(F.col("place") <= k)


def search(vectors: DataFrame, is_query, k: int = 10, sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS, recall: float = RECALL) -> DataFrame:
    """vectors: vec_id, embedding. is_query: a condition on vec_id. Returns query_id, rank, vec_id, score."""
    finite = "x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')"
    v = vectors.select(F.col("vec_id").cast("long"), "embedding").where(f"vec_id IS NOT NULL AND embedding IS NOT NULL AND forall(embedding, {finite}) AND exists(embedding, x -> x <> 0)")
    kind = v.schema["embedding"].dataType.simpleString()  # of whatever numbers
    lengths = v.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    out = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return v.sparkSession.createDataFrame([], out)
    dim = lengths["dim"]
    v = common.written(v.where(F.size("embedding") == dim).distinct())
    smallest = v.withColumn("place", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("place") <= k + 1)
    classes = common.written(smallest.groupBy("embedding").agg(F.min("vec_id").alias("cid"), F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumnRenamed("embedding", "vector"))
    n = classes.count()
    queries = v.where(is_query)
    asked = common.written(queries.groupBy("embedding").agg(F.min("vec_id").alias("qid")).withColumnRenamed("embedding", "vector"))

    # the tree, on a bounded sample
    drawn = classes.orderBy(F.xxhash64("cid"), "cid").limit(sample).select("vector").toArrow()
    points = matrix(drawn.column("vector"), dim)
    tree = Tree(points, max(8, round(leaf_rows * len(points) / n)), FANOUT)

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.assign(matrix(b.column(0), dim)))], ["vector", "cid", "leaf"])

    rows = common.written(classes.select("vector", "cid").mapInArrow(deal, f"vector {kind}, cid long, leaf int"))
    in_leaf = {r["leaf"]: r["count"] for r in rows.groupBy("leaf").count().collect()}  # one row per leaf

    # how many leaves to visit
    probes = asked.orderBy(F.xxhash64("qid", F.lit(1)), "qid").limit(CALIBRATE).toArrow()
    probe_points, probe_ids = matrix(probes.column("vector"), dim), probes.column("qid").to_numpy()

    def brute(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            leaf_of = dict(zip(b.column(1).to_pylist(), b.column(2).to_pylist()))
            q, ids, score = nearest(probe_points, matrix(b.column(0), dim), b.column(1).to_numpy(), k + 1)
            yield pa.RecordBatch.from_arrays([pa.array(probe_ids[q], pa.int64()), pa.array(ids, pa.int64()), pa.array(score, pa.float64()), pa.array([leaf_of[i] for i in ids.tolist()], pa.int32())], ["qid", "cid", "score", "leaf"])

    truth = best(rows.mapInArrow(brute, "qid long, cid long, score double, leaf int"), "qid", k + 1).collect()  # CALIBRATE * (k + 1) rows
    order = {q: {leaf: i for i, leaf in enumerate(tree.best_bins(p))} for q, p in zip(probe_ids.tolist(), probe_points)}
    needed = sorted(order[t["qid"]][t["leaf"]] + 1 for t in truth if t["score"] > 0)
    visits = needed[max(0, int(np.ceil(recall * len(needed))) - 1)] if needed else 1

    def walk(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            number, leaves = [], []
            for i, p in enumerate(matrix(b.column(0), dim)):
                seen = rows_seen = 0
                for leaf in tree.best_bins(p):
                    number.append(i)
                    leaves.append(leaf)
                    seen, rows_seen = seen + 1, rows_seen + in_leaf.get(leaf, 0)
                    if seen >= visits and rows_seen > k:
                        break
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(number, pa.int64())) for c in (0, 1)), pa.array(leaves, pa.int32())], ["vector", "qid", "leaf"])

    walks = common.written(asked.select("vector", "qid").mapInArrow(walk, f"vector {kind}, qid long, leaf int"))
    asking = {r["leaf"]: r["count"] for r in walks.groupBy("leaf").count().collect()}
    blocks = [(leaf, -(-in_leaf.get(leaf, 0) // BLOCK_ROWS), -(-asking[leaf] // BLOCK_QUERIES)) for leaf in asking if in_leaf.get(leaf)]
    sizes = v.sparkSession.createDataFrame(blocks, "leaf int, row_blocks int, query_blocks int")  # one row per leaf
    left = rows.join(F.broadcast(sizes), "leaf").select("vector", "cid", "leaf", F.expr("int(pmod(xxhash64(cid), row_blocks))").alias("rb"), F.explode(F.expr("sequence(0, query_blocks - 1)")).alias("qb"))
    right = walks.join(F.broadcast(sizes), "leaf").select("vector", "qid", "leaf", F.explode(F.expr("sequence(0, row_blocks - 1)")).alias("rb"), F.expr("int(pmod(xxhash64(qid), query_blocks))").alias("qb"))

    def measure(r: pa.Table, q: pa.Table) -> pa.Table:
        i, ids, score = nearest(matrix(q.column("vector"), dim), matrix(r.column("vector"), dim), r.column("cid").to_numpy(), k + 1)
        return pa.table({"qid": pa.array(q.column("qid").to_numpy()[i] if len(q) else [], pa.int64()), "cid": pa.array(ids, pa.int64()), "score": pa.array(score, pa.float64())})

    group = ["leaf", "rb", "qb"]
    found = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(measure, "qid long, cid long, score double")
    found = best(found, "qid", k + 1).join(classes.select("cid", "ids"), "cid").select("qid", "score", F.explode("ids").alias("vec_id"))
    askers = queries.select(F.col("vec_id").alias("query_id"), "embedding").join(asked, F.expr("embedding = vector")).select("query_id", "qid")
    found = askers.join(found, "qid").where("query_id <> vec_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


#: The exact answer, to measure recall against; not an oracle.
EXACT = """
WITH q AS (SELECT vec_id AS query_id, embedding AS a FROM embeddings WHERE vec_id % 100 = 0)
SELECT query_id, vec_id, score FROM (
  SELECT query_id, vec_id, sqrt(list_sum(list_transform(list_zip(a::DOUBLE[], embedding::DOUBLE[]), lambda x: (x[1] - x[2]) * (x[1] - x[2])))) AS score,
    row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank
  FROM q JOIN embeddings ON query_id <> vec_id) WHERE rank <= 10
"""

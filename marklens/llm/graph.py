"""Connected components by alternating large and small stars.

Each step moves edges towards the smallest node of a neighbourhood: per node, its neighbours are
linked with their minimum. Minima are combined before the shuffle, and joins on a node with very
many neighbours are split by Spark (skew join). Each step is written, so lineage stays short, and
the one before it is deleted. The steps end when every edge joins a node to its root: no node then
has two roots, and no root has one of its own. Before and between the steps each task turns the edges it has into
stars (a bounded number at a time), so graphs of a few tasks take a step or none; each step is many jobs, and
these cost the driver memory.

Defined cases: edges from a node to itself and repeated edges say nothing; no edges give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Edges that a task takes at once, and stars that it keeps at most. No effect on results.
AT_ONCE, KEPT = 200_000, 300_000


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node but roots, and its root: the smallest node that these edges lead to."""
    names, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    one, two, root = place[: len(u)], place[len(u) :], np.arange(len(names))
    while (apart := root[one] != root[two]).any():
        one, two = one[apart], two[apart]
        np.minimum.at(root, np.maximum(root[one], root[two]), np.minimum(root[one], root[two]))
        while ((up := root[root]) != root).any():
            root = up
    below = np.flatnonzero(root != np.arange(len(names)))
    return names[below], names[root[below]]


def locally_joined(edges: DataFrame) -> DataFrame:
    """u, v: edges that connect what those (u, v) connect; of each task's edges, stars."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held, waiting = (np.empty(0, np.int64), np.empty(0, np.int64)), [], 0
        made = lambda: stars(*(np.concatenate([kept[i], *(b[i] for b in held)]) for i in (0, 1)))
        for b in it:
            held.append([b.column(i).to_numpy() for i in (0, 1)])
            waiting += b.num_rows
            if waiting >= AT_ONCE:
                kept, held, waiting = made(), [], 0
                if len(kept[0]) > KEPT:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in kept], ["u", "v"])
                    kept = kept[0][:0], kept[1][:0]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in made()], ["u", "v"])

    return edges.select("u", "v").mapInArrow(common.tidy(batches), "u long, v long")


def is_forest_of_stars(e: DataFrame) -> bool:
    """Whether each u of the edges (u, v) has one v, and no v is a u."""
    sides = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    sides = sides.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return sides.where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> node, root, a written table: for each node of an edge the smallest node it can reach."""
    pair = F.struct(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).alias("e")
    e = common.written(locally_joined(edges.where("a <> b").select(pair).select("e.*").distinct()))
    while not is_forest_of_stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).withColumn("m", F.least("node", "m"))
        large = both.where("v > u").join(low, F.expr("u = node")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
        small = large.join(low, F.expr("u = node"))
        next_ = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("node").alias("u"), F.col("m").alias("v"))).distinct()
        last, e = e, common.written(locally_joined(next_))
        common.forget(last)
    roots = common.written(e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
    common.forget(e)
    return roots

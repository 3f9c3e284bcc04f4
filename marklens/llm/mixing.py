"""Mixing sources to target weights by hash-random order and distributed prefix sums.

1. Each document gets a hash-random key (md5 of seed and id). Its leading digits name a key range,
   so (source, range) splits even a source that holds most rows into pieces of bounded size.
2. Sums per (source, range) give each range its offset; a window inside each range adds the running
   sum. Together they are the exact prefix sum over the source in key order.
3. Each source's budget is whole epochs plus a rest; the rest is cut at the exact word, so the
   words taken add up to the budget's whole part.

Budgets are filled like connected vessels: share x weight, never above ``max_epochs`` times the
source's size; what the full ones cannot hold goes to the others by weight. The level is found in
closed form: in ascending order of capacity per weight, a source is full if the level that would
hold without it exceeds its capacity.

Defined cases: null text has size 0, the null source comes last, sources of size 0 get target 0,
ties in the key (null or repeated ids) are ordered by size, and rows equal in
source, id and size are one row of a window, taken apart after it; an empty table gives no rows. Mixes of whole
documents tell rows apart by source, id and text, which are then the key, so that rows with null or
repeated ids each have their own place; of rows equal in all three, as many are repeated as the mix starts.
Very long texts count in full; further columns, whatever their names, pass through :func:`mixed_documents`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Rows that a key range should hold on average, so that a window's partition stays small.
RANGE_ROWS = 2_000


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def row_key() -> Column:
    """128 bits of text, source and id, nulls told apart."""
    known = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    # digests have one length, so no two rows run together
    return F.unhex(F.md5(F.concat(F.md5(known("text").cast("binary")), F.md5(known("source").cast("binary")), known("doc_id")).cast("binary")))


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, max_epochs: int) -> DataFrame:
    """source, source_size -> plus target. One row per source."""
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    by_code_point = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("rank", F.row_number().over(by_code_point)).withColumn("w", w)
    fill = Window.orderBy(F.col("source_size") / F.col("w"), "rank")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = s.select(
        "*",
        (F.sum("source_size").over(everything) * F.lit(share)).alias("budget"),
        F.sum("w").over(everything).alias("all_w"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("s_before"),
        F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w_before"),
    )
    level = (F.col("budget") - max_epochs * F.col("s_before")) / (F.col("all_w") - F.col("w_before"))
    s = s.withColumn("full", level * F.col("w") > max_epochs * F.col("source_size"))
    s = s.select(
        "*",
        F.coalesce(F.sum(F.when(F.col("full"), F.col("source_size"))).over(everything), F.lit(0)).alias("s_full"),
        F.coalesce(F.sum(F.when(F.col("full"), F.col("w"))).over(everything), F.lit(0)).alias("w_full"),
    )
    level = (F.col("budget") - max_epochs * F.col("s_full")) / F.nullif(F.col("all_w") - F.col("w_full"), F.lit(0))
    target = F.when(F.col("full"), (max_epochs * F.col("source_size")).cast("double")).otherwise(level * F.col("w"))
    return s.select("source", "source_size", target.alias("target"))


def mixed(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2, seed: str = "mix", by_row: bool = False) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, copies.

    taken: words the mix takes, repeats counted, cut inside a document where the budget ends.
    copies: how often the mix starts the document; for mixes of whole documents.
    by_row: the key is made of source, id and text, not of the id alone; plus row_key.
    """
    name = [row_key().alias("row_key")] if by_row else []
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.hex(row_key()) if by_row else F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = common.written(docs.select("doc_id", "source", word_count(common.whole_text()).alias("size"), key.alias("key"), *name))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    digits = next(d for d in range(32) if 16**d * RANGE_ROWS >= most)
    rows = rows.withColumn("range", F.substring("key", 1, digits) if digits else F.lit(""))
    targets = source_targets(sizes.drop("n"), weights, share, max_epochs)
    # ranges per source: few thousand rows at most per window, as each stands for RANGE_ROWS rows
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    offset = F.sum("range_size").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(offset, F.lit(0)).alias("offset"))
    ranges = ranges.join(targets, F.expr("s <=> source")).drop("source")
    # equal rows count once, so that a range's window has few rows however often one is repeated
    rows = rows.groupBy("source", "range", "key", "doc_id", "size", *["row_key"][: len(name)]).agg(F.count(F.lit(1)).alias("times"))
    inside = F.sum(F.col("size") * F.col("times")).over(Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("inside", F.coalesce(inside, F.lit(0)))
    rows = rows.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1))).withColumn("inside", F.col("inside") + F.col("nth") * F.col("size"))
    out = rows.join(ranges, F.expr("range = r AND source <=> s"))
    start = F.col("inside") + F.col("offset")
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    out = out.select("*", start.alias("start"), epochs.alias("epochs"), rest.alias("rest"))
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start")))
    copies = F.col("epochs") + F.when(F.col("start") < F.col("rest"), 1).otherwise(0)
    return out.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), copies.cast("int").alias("copies"), *["row_key"][: len(name)])


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself, in whole documents: every row of docs as often as the mix starts it."""
    copies = mixed(docs, by_row=True, **how).groupBy("row_key").agg(F.min("copies").alias("each"), F.sum("copies").alias("total"), F.count(F.lit(1)).alias("n"))
    # equal rows are neighbours in the mix's order, so where its rest ends some of them may have one copy more: at most one key per source
    copies = common.written(copies.where("total > 0").select("row_key", "each", (F.col("total") - F.col("n") * F.col("each")).alias("more")))
    key, copy, place = (common.fresh(docs, c) for c in ("row_key", "copy", "place"))
    keyed = docs.withColumn(key, row_key()).alias("l")
    same = F.expr(f"l.`{key}` = r.row_key")
    rows = keyed.join(common.sent_if_small(copies.where("each > 0").alias("r")), same)
    out = rows.select(*common.all_of(docs, "l."), F.explode(F.sequence(F.lit(1), F.col("r.each"))).alias(copy)).select(*common.all_of(docs))
    extra = keyed.join(common.sent_if_small(copies.where("more > 0").alias("r")), same)
    extra = extra.select(*common.all_of(docs, "l."), F.row_number().over(common.window(f"l.{key}", F.lit(1))).alias(place), F.col("r.more").alias(copy))
    return out.unionByName(extra.where(f"`{place}` <= `{copy}`").select(*common.all_of(docs)))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: The same mix in SQL; share, weights, epochs and seed as in mixed()'s defaults.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS key FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s0),
s2 AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s1),
s3 AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS budget, sum(w) OVER () AS all_w,
         coalesce(sum(source_size) OVER f, 0) AS s_before, coalesce(sum(w) OVER f, 0) AS w_before
  FROM s2 WINDOW f AS (ORDER BY source_size / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, (budget - 2 * s_before) / (all_w - w_before) * w > 2 * source_size AS is_full FROM s3),
s5 AS (SELECT *, coalesce(sum(source_size) FILTER (is_full) OVER (), 0) AS s_full, coalesce(sum(w) FILTER (is_full) OVER (), 0) AS w_full FROM s4),
t AS (SELECT source, source_size,
        CASE WHEN is_full THEN (2 * source_size)::DOUBLE ELSE ((budget - 2 * s_full) / nullif(all_w - w_full, 0)) * w END AS target FROM s5),
p AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d),
x AS (SELECT p.*, t.source_size, t.target,
        CASE WHEN t.source_size > 0 THEN floor(floor(t.target) / t.source_size)::BIGINT ELSE 0 END AS epochs
  FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - start)))::BIGINT AS taken FROM x
"""

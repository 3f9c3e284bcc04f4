"""Exact deduplication by 128-bit content hash, with bytes compared inside each hash group.

Texts are equal when identical after lower-casing A-Z; null counts as empty.

1. ``groupBy(hash, text)`` compares bytes inside each hash group. Spark combines equal texts
   before the shuffle, so a group that holds a third of all rows sends one row per map task.
2. ``groupBy(hash)`` on those classes counts the different texts behind a hash. One text: the
   hash names its class, and documents find it by the hash alone, without moving their text.
   More than one (a collision): these documents, and only these, find their class by the text.

Defined cases: rows with a null id take part, but stay only if all ids of their group are null;
rows repeated with the same id and text are one document and share its flag, and deduplicated() keeps
one row of it; an empty table gives no rows; very long texts are hashed and compared whole; other columns of
the input, whatever their names, are ignored, and pass through deduplicated().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", content_hash: Callable[[Column], Column] = md5_128
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    keep: "min" or "max", which id of a group stays. content_hash: any hash; a weak one costs
    time, not correctness.
    """
    pick = {"min": F.min, "max": F.max}[keep]
    rows = docs.select(F.col(id_col).alias("doc_id"), common.ascii_lower(common.whole_text(text_col)).alias("norm"))
    rows = rows.withColumn("h", content_hash(F.col("norm")))
    classes = rows.groupBy("h", "norm").agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = common.written(
        classes.groupBy("h").agg(F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))
    )
    digest = F.sha2("norm", 256).alias("text_sha256")
    found = rows.select("doc_id", "h", digest).join(groups.where("texts = 1").drop("texts"), "h").drop("h")
    collided = groups.where("texts > 1").select("h")
    if not collided.isEmpty():
        some = rows.join(collided, "h")
        exact = some.groupBy("h", "norm").agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        found = found.unionByName(some.join(exact, ["h", "norm"]).select("doc_id", digest, "keep_id", "group_size"))
    return found.select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs, all columns, that stay; columns may have any names."""
    groups = exact_groups(docs, id_col, text_col, **how).where("group_size > 1").groupBy("doc_id", "text_sha256", "kept")
    # rows that go, and rows kept of which there are several
    keys = common.written(groups.agg(F.count(F.lit(1)).alias("n")).where("NOT kept OR n > 1").drop("n")).alias("r")
    digest = common.fresh(docs, "digest")
    keyed = docs.withColumn(digest, F.sha2(common.ascii_lower(common.whole_text(text_col)), 256))
    same = F.expr(f"l.`{id_col}` <=> r.doc_id AND l.`{digest}` = r.text_sha256")
    rest = keyed.alias("l").join(common.sent_if_small(keys), same, "left_anti").select(*common.all_of(docs))
    repeated = keys.where("kept")
    if repeated.isEmpty():
        return rest
    some = keyed.alias("l").join(common.sent_if_small(repeated), same, "left_semi")
    return rest.unionByName(common.one_each(some, [id_col, digest], docs, text_col))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(common.table(spark, sf_dir, "documents"), keep="max")


ORACLE = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)
"""

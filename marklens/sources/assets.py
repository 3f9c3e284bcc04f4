"""Assets: one row per file or text, with asset_id, path, length and content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 64 * 1024 * 1024


def files(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """All files below path; larger ones keep their row, with null content."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select(F.xxhash64("path").alias("asset_id"), "path", "length", F.when(F.col("length") <= most_bytes, F.col("content")).alias("content"))


def texts(table: DataFrame, id_col: str, text_col: str) -> DataFrame:
    content = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return table.select(F.col(id_col).cast("long").alias("asset_id"), F.lit(None).cast("string").alias("path"), F.length(content).cast("long").alias("length"), content.alias("content"))

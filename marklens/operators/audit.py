"""What a corpus of assets holds: counts over all combinations of format, class and state at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Relative standard deviation of the counts of distinct assets.
DEVIATION = 0.02


def rolled_up(found: DataFrame, *by: str, deviation: float = DEVIATION) -> DataFrame:
    """found: detections, long (asset_id and by). A row per combination of by and of every subset of it: by (null where it is summed
    over), level (a bit per column of by, set where it is summed over), rows, and assets, about how many distinct ones.

    One pass: rows are expanded by the grouping sets and combined before the shuffle; sketches of one size stand in for sets of ids, so
    groups may hold any number of assets. Null ids are not counted among assets; an empty table gives the one row of all (zeros).
    """
    return found.cube(*by).agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("asset_id", deviation).alias("assets"))

"""Where cleaned files go, and which are written: a decision per file, before anything is.

Files keep their place below the output folder, with the extension of the format they are emitted in. Of files
that would be written to one place, the first by path is; that one is found by a grouped minimum, combined before
the shuffle, so a place that many files share is no window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Extensions by format, the first one for new names.
EXTENSIONS = {"jpeg": ["jpg", "jpeg"], "png": ["png"], "webp": ["webp"], "riff-wav": ["wav"], "flac": ["flac"], "isobmff": ["mp4", "m4a", "mov"], "mp3": ["mp3"]}
EXIT_USAGE = 2


def relative_to(files: DataFrame, root: str) -> DataFrame:
    """files (path) with relative: the path below root, or the file's name if it lies elsewhere."""
    root = root.rstrip("/") + "/"
    below = F.col("path").startswith(root)
    return files.withColumn("relative", F.when(below, F.substr(F.col("path"), F.lit(len(root) + 1))).otherwise(F.substring_index("path", "/", -1)))


def destinations(files: DataFrame, folder: str) -> DataFrame:
    """files (relative, format) with dest."""
    extension = F.create_map(*(F.lit(x) for form, names in EXTENSIONS.items() for x in (form, names[0])))[F.col("format")]
    named = F.regexp_replace("relative", r"(?<=[^/])\.[^./]*$", "")
    return files.withColumn("dest", F.concat(F.lit(folder.rstrip("/") + "/"), F.when(extension.isNull(), F.col("relative")).otherwise(F.concat_ws(".", named, extension))))


def decided(files: DataFrame, existing: DataFrame | None = None, overwrite: bool = False) -> DataFrame:
    """files (path, dest, no_op, exit_code) -> path, dest, decision, exit_code: a row per file.

    decision: names the input; collides (another file of this run is written there); exists; no-op; write. The first three
    are usage errors. A file whose run failed (exit_code other than 0) is "failed" and keeps its code. existing: paths that are there already.
    """
    rows = files.select("path", "dest", F.coalesce("no_op", F.lit(False)).alias("no_op"), "exit_code")
    if existing is None or overwrite:
        rows = rows.withColumn("there", F.lit(False))
    else:
        there = existing.select(F.col("path").alias("found")).distinct()
        rows = rows.join(there, F.expr("dest = found"), "left_outer").withColumn("there", F.col("found").isNotNull()).drop("found")
    same = F.col("path") == F.col("dest")
    would = (F.col("exit_code") == 0) & ~same & ~F.col("there") & ~F.col("no_op")
    first = rows.where(would).groupBy(F.col("dest").alias("place")).agg(F.min("path").alias("first"))
    rows = rows.join(first, F.expr("dest = place"), "left_outer")
    decision = (
        F.when(F.col("exit_code") != 0, "failed").when(same, "names the input").when(F.col("path") > F.col("first"), "collides")
        .when(F.col("there"), "exists").when(F.col("no_op"), "no-op").otherwise("write")
    )
    code = F.when(decision.isin("names the input", "collides", "exists"), EXIT_USAGE).otherwise(F.col("exit_code"))
    return rows.select("path", "dest", decision.alias("decision"), code.alias("exit_code"))

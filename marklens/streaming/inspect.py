"""Reports of a stream of files, each file once.

The stream lists files; a state by path and length drops what was listed before, whatever a source or a restart lists again. Only then
are contents read, so none goes through the state's shuffle. Listing, state and reports advance together by the checkpoint: a query that
stops and starts again goes on where it was, and its sink of files holds each report once. Files without a byte, and those whose names
begin with a dot or an underscore, are not listed by Spark's file sources (sources/inputs.py lists them).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import report
from ..plans import policy as P
from ..sources.assets import MOST_BYTES
from ..sources.inputs import store_of

LISTED = "path string, modificationTime timestamp, length long, content binary"


def contents(path: Column) -> Column:
    """The files' contents; null for null, and for files that are gone since."""

    def read(paths: pa.Array) -> pa.Array:
        out = []
        for p in paths.to_pylist():
            try:
                store, inside = store_of(p) if p is not None else (None, None)
                out.append(store and store.open_input_stream(inside).read())
            except FileNotFoundError:
                out.append(None)
        return pa.array(out, pa.binary())

    return F.arrow_udf(read, "binary").asNondeterministic()(path)


def listed(spark: SparkSession, path: str) -> DataFrame:
    """path, length: the files below a path as they come, each path and length once."""
    found = spark.readStream.format("binaryFile").schema(LISTED).option("recursiveFileLookup", "true").load(path)
    # Hadoop writes file:/x; the stores' readers want file:///x
    return found.select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"), "length").dropDuplicates(["path", "length"])


def reported(files: DataFrame, policy: P.Policy | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """files: path, length -> path, length, exit_code, value (the report as JSON): a row per file, those that are no text, too
    large or of no known format too."""
    rows = files.withColumn("content", contents(F.when(F.col("length") <= most_bytes, F.col("path"))))
    rows = report.with_found(rows, "content", "format", "found", policy)
    made = report.reports(rows.select(F.struct("path", "length").alias("asset_id"), "format", "found"), policy)
    return made.select("asset_id.path", "asset_id.length", "exit_code", F.to_json(F.struct(*(c for c in made.columns if c != "asset_id")), {"ignoreNullFields": "false"}).alias("value"))


def started(spark: SparkSession, path: str, out: str, checkpoint: str, **how) -> StreamingQuery:
    """Reports of all files below path that are there and not yet reported, as Parquet below out; then it ends. checkpoint: a folder
    that all executors share, the same one for every start."""
    stream = reported(listed(spark, path), **how).writeStream.format("parquet").option("checkpointLocation", checkpoint)
    return stream.trigger(availableNow=True).start(out)

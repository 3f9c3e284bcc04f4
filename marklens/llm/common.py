"""What the operators of this subpackage share: text normalisation and scratch tables."""

from __future__ import annotations

import contextlib
import functools
import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else (``lower`` would also fold other scripts)."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def whole_text(column: str = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def lowered(text: str | None) -> str:
    """Python's side of :func:`ascii_lower`; bytes.lower() knows ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass") if text else ""


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below the shared folder that the cluster names in spark.checkpoint.dir.

    Only where that is unset, as in tests on one machine, a temporary folder takes its place.
    """
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = _own_folder()
    return f"{shared.rstrip('/')}/marklens-{uuid.uuid4().hex}"


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Settings for the time of a block; what the caller set itself is left alone."""
    ours = [k for k in values if not spark._jsparkSession.sessionState().conf().contains(k)]
    for k in ours:
        spark.conf.set(k, values[k])
    try:
        yield
    finally:
        for k in ours:
            spark.conf.unset(k)


#: While a table is written: the shuffle files that made it go at once, and Arrow and Parquet batches (of texts, of sets) are small.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "4m", "spark.sql.parquet.columnarReaderBatchSize": "1024"}


def written(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes df as Parquet into the shared folder and reads it again."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    with settings(spark, WRITING):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def counted(df: DataFrame) -> DataFrame:
    """Like :func:`written`; ``row_count`` of what it returns is known from the writing, so that asking for it starts no
    job. (Each stage and each broadcast costs the driver some MB until its next garbage collection.)"""
    seen = Observation()
    out = written(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    out.row_count = seen.get["rows"]
    return out


def bucketed(df: DataFrame, keys: DataFrame, key: str, buckets: int) -> DataFrame:
    """Like :func:`written`, but in so many buckets of a key, one row per key that is in keys (distinct ones): joins by it shuffle
    their other side alone. Rows are dealt to buckets first, and joined where they then are, so they too are shuffled once. The join
    is an inner one, as Spark moves a semi-join below the dealing, and then shuffles the rows for it as well."""
    spark = df.sparkSession
    path, name = scratch_dir(spark), f"marklens_{uuid.uuid4().hex}"
    with settings(spark, WRITING):
        rows = df.repartition(buckets, key).join(keys.select(key).repartition(buckets, key), key).dropDuplicates([key])
        rows.write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out.written_to, out.table_name = path, name
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables made by :func:`written` or :func:`bucketed` that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        if name := getattr(t, "table_name", None):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        path = spark._jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """name, or a longer one that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def all_of(df: DataFrame, side: str = "") -> list[Column]:
    """The columns of df by name, whatever characters the names hold."""
    return [F.col(f"{side}`{c.replace('`', '``')}`") for c in df.columns]


#: Most bytes of texts that are looked at at once. No effect on results.
BATCH_BYTES = 2_000_000


def tidy(batches):
    """batches, after which the task's worker gives its freed memory back: idle workers of one stage stay while the next one runs."""

    def run(it):
        import ctypes

        import pyarrow as pa

        yield from batches(it)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
            trim(0)

    return run


def in_batches(df: DataFrame, batches, schema, most: int = BATCH_BYTES) -> DataFrame:
    """mapInArrow over rows of whole texts. A batch that Spark hands over has up to spark.sql.execution.arrow.
    maxRecordsPerBatch rows; ``batches`` sees slices of bounded bytes, so what it makes of them stays small."""
    widest = [i for i, f in enumerate(df.schema) if isinstance(f.dataType, (T.StringType, T.BinaryType))]

    def sliced(it):
        for b in it:
            yield from slices(b, widest, most)

    return df.mapInArrow(tidy(lambda it: batches(sliced(it))), schema)


def slices(batch, columns: list[int], most: int):
    """Parts of an Arrow batch with at most so many bytes in its texts, or one row."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = np.zeros(batch.num_rows, np.int64)
    for c in columns:
        sizes += pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < len(sizes):
        upto = max(at + 1, int(np.searchsorted(before, before[at] + most, side="right")) - 1)
        yield batch.slice(at, upto - at)
        at = upto


def window(partition: str, *order):
    from pyspark.sql import Window

    return Window.partitionBy(partition).orderBy(*order)


#: Rows of a key table that may be sent to all tasks.
SENT_ROWS = 500_000


def sent_if_small(keys: DataFrame, most: int = SENT_ROWS) -> DataFrame:
    """keys (written before), marked for broadcast if it has at most so many rows; else left to a shuffle."""
    rows = vars(keys).get("row_count")
    if rows is None:
        rows = keys.limit(most + 1).count()
    return F.broadcast(keys) if rows <= most else keys


def one_each(rows: DataFrame, by: list[str], like: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of like, of one of the rows per key, the one with the least text; combined before the shuffle."""
    key = [F.col(f"`{c}`").alias(f"by_{i}") for i, c in enumerate(by)]
    row = F.min_by(F.struct(*all_of(like)), whole_text(text_col)).alias("row")
    return rows.groupBy(*key).agg(row).select("row.*")

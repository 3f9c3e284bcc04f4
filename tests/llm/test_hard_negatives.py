"""Hard negatives against a full search, on the tables and on odd ones."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from marklens.llm import hard_negatives, queries

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def full_search(rows, anchor, positives=5, negatives=10, low=30, high=90):
    """rows: (vec_id, label, vector)."""
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for i, label, vector in rows:
        if not anchor(i):
            continue
        scored = sorted(((-dot(vector, w), j, m) for j, m, w in rows if j != i))
        for p, j, _ in [s for s in scored if s[2] == label][:positives]:
            hard = [(s, n) for s, n, m in scored if m != label and -low * p <= -100 * s <= -high * p]
            out += [(i, j, rank, n, -p, -s) for rank, (s, n) in enumerate(hard[:negatives], 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_equal_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/{sf}/embeddings.parquet'")
    want = con.sql(hard_negatives.ORACLE)
    got = queries.QUERIES["op11_hard_negatives"](spark, f"/root/testdata/{sf}")
    assert got.columns == COLUMNS == want.columns
    assert rows_of(got) == sorted(want.fetchall()) != []


@pytest.mark.parametrize("bucket, block_bytes, scale", [(2048, 16_000_000, 9), (7, 300, 9), (3, 100, 3), (7, 300, 3 * 10**8)])
def test_equal_full_search(spark, monkeypatch, bucket, block_bytes, scale):
    """Many ties and copies, norms of all sizes, few and many buckets and blocks; large components leave the doubles."""
    monkeypatch.setattr(hard_negatives, "BUCKET", bucket)
    monkeypatch.setattr(hard_negatives, "AT_ONCE", bucket)
    rng = random.Random(bucket + scale)
    rows = [(i, rng.randrange(3), [rng.randrange(-1, scale) for _ in range(4)]) for i in range(120)]
    rows += [(200 + i, i % 2, rows[5][2]) for i in range(60)] + [(300, 1, [0, 0, 0, 0]), (301, 1, [scale * 5] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, label int, vector array<long>").repartition(3)
    got = hard_negatives.mined(df, "vec_id % 10 = 0", block_bytes=block_bytes)
    assert rows_of(got) == full_search(rows, lambda i: i % 10 == 0) != []


def test_buckets_are_left_out():
    """Norms that no anchor wants are never compared."""
    import numpy as np
    import pyarrow as pa

    seen = []

    class Watched(np.ndarray):
        def __matmul__(self, other):
            seen.append(other.shape[1])
            return np.asarray(self) @ np.asarray(other)

    class Rows:
        def mapInArrow(self, run, schema):
            vectors = np.repeat(np.arange(100, 0, -1), 2)
            batch = pa.table({"vec_id": np.arange(1, 201), "label": np.zeros(200, int), "vector": [[int(v)] for v in vectors], "norm": vectors.astype(float)})
            return [r for b in run(iter(batch.to_batches(10))) for r in b.to_pylist()]

    anchor = np.array([[2.0]]).view(Watched)
    found = hard_negatives.Search(Rows(), np.array([0]), np.array([0]), anchor, np.array([2.0])).positives(5)
    assert [(r["id"], r["score"]) for r in found] == [(1, 200), (2, 200), (3, 198), (4, 198), (5, 196)] and seen == [10]


def test_odd_rows(spark):
    schema = "vec_id long, label int, embedding array<double>"
    good = [(i, i % 2, [1.0 + i % 3, 0.5]) for i in range(0, 40, 5)]
    odd = [(None, 0, [1.0, 1.0]), (1, None, [1.0, 1.0]), (2, 0, None), (3, 0, [None, 1.0]), (4, 1, [float("nan"), 1.0]), (6, 1, [float("inf"), 1.0]), (8, 0, [1.0]), (9, 1, []), good[3]]
    clash = lambda df: df.withColumn("norm", F.lit("x")).withColumn("slot", F.lit(1)).withColumn("vector", F.lit(2))
    run = lambda rows: rows_of(hard_negatives.mined(hard_negatives.quantised(clash(spark.createDataFrame(rows, schema))), "vec_id % 10 = 0"))
    want = full_search([(i, (m + 1) % 10 if i % 7 == 0 else m, [int(256 * x) for x in v]) for i, m, v in good], lambda i: i % 10 == 0)
    assert run(good + odd) == run(good) == want != []
    assert run([]) == run(odd[:8]) == run([(10, 1, [1.0, 2.0])]) == []
    floats = spark.createDataFrame(good, schema).withColumn("embedding", F.col("embedding").cast("array<float>"))
    assert rows_of(hard_negatives.mined(hard_negatives.quantised(floats), "vec_id % 10 = 0")) == want
    assert hard_negatives.mined(hard_negatives.quantised(spark.createDataFrame([], schema)), "vec_id % 10 = 0").columns == COLUMNS


def test_too_large_scores_fail(spark):
    df = spark.createDataFrame([(0, 1, [2**40, 1]), (1, 2, [2**40, 1])], "vec_id long, label int, vector array<long>")
    with pytest.raises(ValueError, match="64-bit"):
        hard_negatives.mined(df, "vec_id % 10 = 0")

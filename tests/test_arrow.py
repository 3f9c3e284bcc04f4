"""Functions over columns of files see a few of a batch's rows at a time."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marklens.functions import arrow
from marklens.operators import fidelity, pixelmark


@pytest.mark.parametrize("files", [False, True])
def test_rows_keep_their_order_and_slices_stay_small(spark, files):
    def each(ids: pa.Array, content: pa.Array) -> pa.Array:
        return pa.array([f"{i}:{len(c or b'')}:{len(ids)}" for i, c in zip(ids.to_pylist(), content.to_pylist())])

    size = F.expr("CASE WHEN id % 7 = 0 THEN NULL WHEN id = 100 THEN 3000000 ELSE 1000 END")
    rows = spark.range(0, 4000, 1, 1).select("id", size.cast("int").alias("n"), F.expr("CAST(repeat('x', CASE WHEN id = 100 THEN 3000000 ELSE 1000 END) AS BINARY)").alias("t"))
    rows = rows.select("id", "n", F.when(F.col("n").isNotNull(), F.col("t")).alias("t"))
    got = rows.select("id", "n", arrow.by_slices(each, "string", files)(F.col("id"), F.col("t")).alias("r")).collect()
    assert len(got) == 4000
    for r in got:
        i, n, together = map(int, r["r"].split(":"))
        assert (i, n) == (r["id"], r["n"] or 0) and together <= arrow.FILES
        assert together == 1 or n * together <= 2 * arrow.AT_ONCE


def test_no_rows_and_one_large_row():
    assert list(arrow.slices((pa.array([], pa.binary()),))) == []
    assert [len(p[0]) for p in arrow.slices((pa.array([b"x" * 3 * arrow.AT_ONCE, None, b""]),))] == [1, 2]


def test_operators_look_at_few_files_at_once(spark, monkeypatch):
    """What the named queries run: their functions are made by by_slices."""
    seen = []
    monkeypatch.setattr(arrow, "by_slices", lambda each, kind, files=False: seen.append(each.__name__) or (lambda *c: F.lit(None).cast(kind)))
    pixelmark.votes(F.lit(None), F.lit("png"))
    fidelity.totals(F.lit("png"), F.lit(None))
    assert seen == ["vote", "each"]

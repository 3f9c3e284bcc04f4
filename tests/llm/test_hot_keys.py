"""Rows that share a key, and element types."""

import collections

import numpy as np
from pyspark.sql import functions as F

from marklens.llm import ann, mixing


def test_null_and_repeated_ids_are_few_rows_of_a_window(spark):
    """Thousands of rows without an id or with one id: the windows see a row per size, and every row gets its own part."""
    rows = [(None, "a b c", "s")] * 3000 + [(7, "x y", "s")] * 1000 + [(None, "d", "s")] * 500 + [(i, "w " * (i % 5), "t") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    made = mixing.mixed(docs)
    got = made.collect()
    assert len(got) == len(rows)
    per = collections.defaultdict(lambda: [0, 0])
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        per[r["source"]][0] += r["taken"]
        per[r["source"]][1] = r["target"]
    assert all(taken == int(target) for taken, target in per.values())
    cut = [r for r in got if r["source"] == "s" and r["taken"] not in (r["size"], 2 * r["size"], 0)]
    assert len(cut) <= 1  # the budget ends inside of one row
    again = collections.Counter((r["doc_id"], r["size"], r["taken"]) for r in mixing.mixed(docs.repartition(5)).collect())
    assert again == collections.Counter((r["doc_id"], r["size"], r["taken"]) for r in got)


def test_doubles_and_integers_are_searched(spark):
    some = np.random.default_rng(2).integers(-9, 9, (60, 4))
    want = None
    for kind in ("float", "double", "int"):
        rows = [(i, [float(x) if kind != "int" else int(x) for x in v]) for i, v in enumerate(some)]
        df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumn("qid", F.lit(1)).withColumn("leaf", F.lit("x")).withColumn("score", F.lit(2))
        got = sorted(map(tuple, ann.search(df, "vec_id % 20 = 0", k=3, recall=1.0).collect()))
        want = want or got
        assert got == want and len(got) == 9
        for q, _, j, score in got:
            assert abs(score - float(np.sqrt(((some[q] - some[j]) ** 2).sum()))) < 1e-9

"""What a query costs the driver: each job leaves it stages, plans and broadcasts."""

import numpy as np
from pyspark.sql import functions as F

from marklens.llm import common, graph


def jobs_of(spark, run):
    """What run() returns, and how many jobs it started."""
    context, group = spark.sparkContext, f"counted-{np.random.default_rng().integers(2**60)}"
    context.setJobGroup(group, "")
    try:
        out = run()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    return out, len(context.statusTracker().getJobIdsForGroup(group))


def test_components_of_few_tasks_take_few_jobs(spark):
    """A path in random order joins within its task: no step over all edges is needed."""
    at = np.random.default_rng(3).permutation(600).tolist()
    edges = spark.createDataFrame([*zip(at[:400], at[1:401]), *zip(at[401:], at[402:])], "a long, b long")
    found, jobs = jobs_of(spark, lambda: graph.components(edges))
    want = {x: min(part) for part in (at[:401], at[401:]) for x in part}
    assert {r["node"]: r["root"] for r in found.collect()} == want
    assert jobs <= 9


def test_components_over_many_tasks(spark, monkeypatch):
    """Where tasks keep few stars, the steps do the rest."""
    monkeypatch.setattr(graph, "AT_ONCE", 7)
    monkeypatch.setattr(graph, "KEPT", 3)
    made = np.random.default_rng(4).integers(-(2**40), 2**40, 300).tolist()
    pairs = [(made[i], made[i + 5]) for i in range(295)] + [(x, x) for x in range(20)]
    found = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(pairs, "a long, b long").repartition(9)).collect()}
    assert found == {x: min(made[i % 5 :: 5]) for i, x in enumerate(made)}


def test_stars():
    random = np.random.default_rng(5)
    for n in (1, 5, 60):
        for _ in range(30):
            u, v = random.integers(0, n, (2, random.integers(0, 2 * n)))
            got = dict(zip(*(x.tolist() for x in graph.stars(u, v))))
            want = {x: x for x in [*u.tolist(), *v.tolist()]}
            for _ in want:
                for x, y in zip(u.tolist(), v.tolist()):
                    want[x] = want[y] = min(want[x], want[y])
            assert got == {k: r for k, r in want.items() if k != r}


def test_rows_are_counted_while_written(spark):
    """Also of no rows, and of tables with a column of that name; the count is asked for without a job."""
    for n in (0, 1, 1000):
        df = spark.range(n).withColumn("row_count", F.lit(9)).repartition(3)
        kept, first = jobs_of(spark, lambda: common.counted(df))
        assert kept.row_count == n == kept.count()
        sent, jobs = jobs_of(spark, lambda: common.sent_if_small(kept, 999))
        assert jobs == 0 and ("hint" in sent._jdf.queryExecution().logical().toString().lower()) == (n < 1000)
    nothing = common.counted(spark.range(5).where(F.lit(False)))
    assert nothing.row_count == 0
    common.forget(nothing)

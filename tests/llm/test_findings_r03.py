"""What the check tool found in round 3: the plans of the near-duplicate stage took more than the driver's memory."""

import random

import pytest

from orrery.llm import components as graph
from orrery.llm.scratch import written
from orrery.llm.skew import FEW, lookup


def _jobs(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_components_of_a_small_table_take_a_few_jobs(spark, monkeypatch):
    """A chain took a dozen queries in rounds; one task finds the same labels, here of chains, stars, circles and random edges."""
    draw = random.Random(3)
    edges = [(k, k + 1) for k in range(60)] + [(500, 400 + k) for k in range(50)] + [(1000 + k, 1000 + (k + 1) % 30) for k in range(30)] + [(-5, -9), (7, 7), (None, 3), (4, None), (5000, 5000)]
    edges += [(draw.randrange(10**6, 10**6 + 400), draw.randrange(10**6, 10**6 + 400)) for _ in range(250)] + [(2**62, 2**62 + k) for k in (1, 2)]
    df = written(spark.createDataFrame(edges, "a long, b long"), "test-edges")
    small, few = _jobs(spark, "small", lambda: sorted(map(tuple, graph.components(df).collect())))
    monkeypatch.setattr(graph, "ALONE", 0)
    rounds, many = _jobs(spark, "rounds", lambda: sorted(map(tuple, graph.components(df).collect())))
    assert small == rounds and (60, 0) in small and (2**62 + 2, 2**62) in small and (-5, -9) in small and 5000 not in dict(small)
    assert few <= 10 < many
    assert graph.components(df.filter("a = b")).count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_without_large_keys_is_a_plain_join(spark, how):
    """It was a union of two joins of three reads, even of tables whose every key has one row."""
    table = spark.createDataFrame([(k, f"t{k}") for k in range(0, 300, 2)], "k long, t string")
    for rows, large in (([(k, k) for k in range(300)], False), ([(k % 3, k) for k in range(FEW)], False), ([(k if k % 4 else 8, k) for k in range(4 * FEW + 400)], True)):
        df = written(spark.createDataFrame([*rows, (None, -1)], "k long, v long"), "test-rows")
        got = lookup(df, table, "k", how)
        assert ("Union" in got._jdf.queryExecution().optimizedPlan().toString()) == large
        names = dict(table.collect())
        want = [(k, v, names.get(k)) for k, v in [*rows, (None, -1)] if how == "left" or k in names]
        assert sorted(map(tuple, got.select("k", "v", "t").collect()), key=str) == sorted(want, key=str)

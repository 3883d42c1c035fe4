"""Submitted reviews and refreshed exports on small tables."""

import pytest

from orrery.operators import refresh, reviews

REVIEW = "language string, target_id long, source_id long, status string, version long"


def outcomes(spark, sent, edges=(("de", 1, 2), ("de", 1, 3)), held=()):
    edges = spark.createDataFrame(list(edges), "language string, target_id long, source_id long")
    held = spark.createDataFrame(list(held), REVIEW)
    return reviews.judged(spark.createDataFrame(sent, REVIEW + ", position long"), edges, held), held


def test_outcomes_of_submissions(spark):
    cases = [
        (("de", 1, 2, "fixed", 3, 1), "saved"), (("de", 1, 2, "bad_link", 3, 2), "conflict"), (("de", 1, 3, "fixed", 1, 3), "conflict"), (("de", 1, 3, "not_fixed", 0, 4), "saved"),
        (("de", 9, 3, "fixed", 0, 5), "missing_edge"), (("all", 1, 2, "fixed", 3, 6), "invalid"), (("de", 1, 1, "fixed", 0, 7), "invalid"), (("de", 0, 2, "fixed", 0, 8), "invalid"),
        (("de", 1, 2, "open", 3, 9), "invalid"), ((None, 1, 2, "fixed", 3, 10), "invalid"), (("de", 1, 2, "fixed", None, 11), "invalid"), (("de", 1, None, None, 3, 12), "invalid"),
    ]
    judged, held = outcomes(spark, [c for c, _ in cases], held=[("de", 1, 2, "not_fixed", 3), ("fr", 5, 6, "fixed", 1)])
    assert {r.position: r.outcome for r in judged.collect()} == {c[-1]: o for c, o in cases}
    after = reviews.applied(judged, held)
    assert sorted(map(tuple, after.collect())) == [("de", 1, 2, "fixed", 4), ("de", 1, 3, "not_fixed", 1), ("fr", 5, 6, "fixed", 1)]
    assert [tuple(r) for r in reviews.listed(after, ["fr", "fr"]).collect()] == [("fr", 5, 6, "fixed", 1)]


def test_repeated_and_no_submissions(spark):
    judged, held = outcomes(spark, [("de", 1, 2, "fixed", 0, 1)] * 2 + [("de", 1, 2, "fixed", 1, 2)], edges=[("de", 1, 2)] * 2)
    assert sorted(r.outcome for r in judged.collect()) == ["conflict", "saved", "saved"]
    assert [tuple(r) for r in reviews.applied(judged, held).collect()] == [("de", 1, 2, "fixed", 1)]
    judged, held = outcomes(spark, [], held=[("de", 1, 2, "fixed", 1)])
    assert [tuple(r) for r in reviews.applied(judged, held).collect()] == [("de", 1, 2, "fixed", 1)]


def test_refresh(spark):
    rows = spark.createDataFrame([("a", 1, 5, "x"), ("b", 2, 6, "y"), (None, 3, 7, "z")], "id string, degree long, age long, key string")
    ages = spark.createDataFrame([("a", 50), ("c", 60)], "id string, age long")
    out = refresh.refreshed(rows, [ages], ["id"])
    assert out.columns == rows.columns
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([("a", 1, 50, "x"), ("b", 2, None, "y"), (None, 3, None, "z")], key=repr)
    assert sorted(map(tuple, refresh.unmatched(rows, ages, ["id"]).collect()), key=repr) == sorted([("b", "missing"), (None, "missing"), ("c", "unknown")], key=repr)
    assert [tuple(r) for r in refresh.duplicated(rows.union(rows.filter("id IS NULL")), ["id"]).collect()] == [(None, 2)]
    with pytest.raises(ValueError):
        refresh.refreshed(rows, [ages.withColumnRenamed("age", "weight")], ["id"])

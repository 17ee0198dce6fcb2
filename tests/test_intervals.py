"""Interval sets against membership of points."""

import random

import pytest

from tidewell.operators import intervals

DDL = "g string, lo double, hi double, lo_in boolean, hi_in boolean"


def _set(rng, n, groups):
    ends = lambda: rng.choice([None, *[float(k) for k in range(6)]])
    flag = lambda: rng.choice([True, False, None])
    return [(rng.choice(groups), ends(), ends(), flag(), flag()) for _ in range(n)]


def _has(rows, g, x):
    return any(
        r[0] == g and (r[1] is None or r[1] < x or r[1] == x and r[3]) and (r[2] is None or x < r[2] or x == r[2] and r[4]) for r in rows
    )


POINTS = [k / 2 for k in range(-2, 13)]


@pytest.mark.parametrize("seed", range(3))
def test_every_operation_by_points(spark, seed):
    rng = random.Random(seed)
    a, b = _set(rng, 14, ["a", "b", None]), _set(rng, 10, ["a", "c", None])
    a += [("empty", 3.0, 3.0, True, False), ("empty", 5.0, 2.0, True, True), ("point", 3.0, 3.0, True, True)]
    left, right = spark.createDataFrame(a, DDL), spark.createDataFrame(b, DDL)
    want = {
        "union": lambda x, y: x or y,
        "intersection": lambda x, y: x and y,
        "difference": lambda x, y: x and not y,
    }
    groups = {r[0] for r in a} | {r[0] for r in b}
    for name, holds in want.items():
        got = [tuple(r) for r in getattr(intervals, name)(left, right, ["g"]).collect()]
        for g in groups:
            for x in POINTS:
                inside = [r for r in got if _has([r], g, x)]
                assert len(inside) == holds(_has(a, g, x), _has(b, g, x)), (name, g, x)
    got = [tuple(r) for r in intervals.complement(left, ["g"]).collect()]
    assert all(_has(got, g, x) != _has(a, g, x) for g in {r[0] for r in a} for x in POINTS)
    assert ("empty", None, None, False, False) in got
    for r in intervals.relations(left, right, ["g"]).collect():
        both = [(_has(a, r.g, x), _has(b, r.g, x)) for x in POINTS]
        assert r.is_subset == all(y or not x for x, y in both)
        assert r.is_superset == all(x or not y for x, y in both)
        assert r.is_disjoint == (not any(x and y for x, y in both))


def test_results_are_disjoint_and_do_not_touch(spark):
    rows = [("g", 0.0, 1.0, True, False), ("g", 1.0, 2.0, True, False), ("g", 2.0, 3.0, False, True), ("g", 1.5, 1.7, True, True)]
    got = sorted(map(tuple, intervals.merged(spark.createDataFrame(rows, DDL), ["g"]).collect()))
    assert got == [("g", 0.0, 2.0, True, False), ("g", 2.0, 3.0, False, True)]


def test_empty_operands_and_one_set_without_groups(spark):
    none, one = spark.createDataFrame([], DDL), spark.createDataFrame([("g", 1.0, 2.0, True, True)], DDL)
    assert intervals.union(none, none, ["g"]).count() == 0 and intervals.complement(none, ["g"]).count() == 0
    assert [tuple(r) for r in intervals.difference(one, none, []).collect()] == [(1.0, 2.0, True, True)]
    assert intervals.relations(none, one, ["g"]).first().asDict() == {"g": "g", "is_subset": True, "is_superset": False, "is_disjoint": True}


@pytest.mark.parametrize("large", [3, 0])
def test_large_groups_go_by_ranges(spark, monkeypatch, large):
    monkeypatch.setattr(intervals, "LARGE", large)
    test_every_operation_by_points(spark, 7)
    test_results_are_disjoint_and_do_not_touch(spark)
    test_empty_operands_and_one_set_without_groups(spark)


def test_intervals_are_shuffled_once(spark):
    """Twice with the join that the operands may need; relations take one sweep."""
    a = spark.createDataFrame(_set(random.Random(1), 20, ["a", "b"]), DDL)
    for got in (intervals.union(a, a, ["g"]), intervals.relations(a, a, ["g"])):
        assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


@pytest.mark.parametrize("of", [intervals.union, intervals.intersection, intervals.difference])
def test_groups_that_a_task_can_hold_are_dealt_once(spark, monkeypatch, of):
    """Their cuts are not ranked by ranges, which writes and shuffles each cut several times."""
    monkeypatch.setattr(intervals, "running_totals", None)
    a, b = (spark.createDataFrame(_set(random.Random(k), 30, ["a", "b", None]), DDL) for k in (1, 2))
    got = of(a, b, ["g"])
    assert got.count() and got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1

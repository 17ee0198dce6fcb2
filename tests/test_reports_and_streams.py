"""Test reports, tiled products, recurring dates and the log's bookmark."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidewell import registry
from tidewell.functions import recurrence as R
from tidewell.operators import gates, reports, tiles
from tidewell.streaming import log

VERBOSE = """$ python -m pytest -v
tests/a.py::T::test_one PASSED   [ 10%]
tests/a.py::test_two FAILED
tests/a.py::test_three SKIPPED (why)
  tests/a.py::test_four XFAIL
tests/a.py::test_five ERROR
tests/a.py::test_six passed
tests/a.py::test_seven deselected
SKIPPED [1] tests/a.py:3: why
tests/a.py::test_two PASSED
==== 3 passed, 1 failed in 0.1s (see x::y) ====
FAILED tests/b.py::test_eight - boom
"""
NUMBERED = """    Start 1: heat
 1/6 Test #1: heat .............   Passed    0.10 sec
 2/6 Test  #2: wave_Failed .......***Timeout  9.00 sec
 3/6 Test #3: flow ...***Failed  Required regular expression
 4/6 Test #4: gone ...***Not Run   0.00 sec
 5/6 Test #5: off ......Not Run (Disabled)   0.00 sec
 6/6 Test #6: late .......   Passed
Testing done: Test no number
 Test #7: noverdict ....
The following tests FAILED:
\t  3 - flow (Failed)
\t  6 - late (Timeout)
\t  8 - with - dash (x) (Not Run)
\t  9 - odd (Strange)
 7/7 Test #1: heat ......   Failed
Errors while running
"""


def test_outcomes_of_both_formats(spark):
    rows = [("v", "verbose", VERBOSE), ("n", "numbered", NUMBERED), ("e", "verbose", ""), ("z", "numbered", None)]
    got = reports.test_outcomes(spark.createDataFrame(rows, "run string, format string, text string"), "run").collect()
    v = {r.test: r.outcome for r in got if r.run == "v"}
    assert v == {
        "tests/a.py::T::test_one": "pass", "tests/a.py::test_two": "pass", "tests/a.py::test_three": "skip", "tests/a.py::test_four": "xfail",
        "tests/a.py::test_five": "fail", "tests/a.py::test_six": "pass", "====": "pass",
    }
    n = {r.test: r.outcome for r in got if r.run == "n"}
    assert n == {"heat": "pass", "wave_Failed": "timeout", "flow": "fail", "gone": "not_run", "off": "skip", "late": "timeout", "with - dash (x)": "not_run"}
    assert {r.run for r in got} == {"v", "n"}


def test_later_parts_win_and_rates_follow(spark):
    rows = [("r", "verbose", 1, "a::x PASSED\na::y PASSED"), ("r", "verbose", 0, "a::x FAILED\na::z FAILED")]
    got = reports.test_outcomes(spark.createDataFrame(rows, "run string, format string, part int, text string"), "run")
    assert {r.test: r.outcome for r in got.collect()} == {"a::x": "pass", "a::y": "pass", "a::z": "fail"}
    assert gates.rates(got, "run").first().asDict() == {"run": "r", "passed": 2, "failed": 1, "total": 3, "pass_rate": 2 / 3}


@pytest.mark.parametrize("tile", [1, 3, 64])
def test_tiled_product(spark, tile):
    rng = np.random.default_rng(tile)
    a, b = rng.integers(-3, 4, (2, 7, 130)), rng.integers(-3, 4, (2, 130, 5))
    long = lambda m: spark.createDataFrame([(g, int(i), int(j), float(m[g, i, j])) for g in range(2) for i, j in zip(*np.nonzero(m[g]))], "g int, i long, j long, value double")
    got = np.zeros((2, 7, 5))
    for r in tiles.multiply(long(a), long(b), ["g"], tile).collect():
        got[r.g, r.i, r.j] = r.value
    assert (got == a @ b).all()


def _plain(start, until, freq, passes, step, position=()):
    """Dates of a recurrence, day by day."""
    day, periods = start - dt.timedelta(days=400), {}
    while day <= until + dt.timedelta(days=400):
        key = {"YEARLY": day.year, "MONTHLY": day.year * 12 + day.month, "WEEKLY": (day - dt.timedelta(days=day.weekday())).toordinal() // 7, "DAILY": day.toordinal()}[freq]
        periods.setdefault(key, []).append(day)
        day += dt.timedelta(days=1)
    first = next(k for k, v in periods.items() if start in v)
    out = []
    for key, days in periods.items():
        if (key - first) % step or key < first:
            continue
        days = [x for x in days if passes(x)]
        if position:
            days = sorted({days[p - 1 if p > 0 else p] for p in position if -len(days) <= p <= len(days)})
        out += [x for x in days if start <= x <= until]
    return out


def _last(day):
    return (day.replace(day=28) + dt.timedelta(days=4)).replace(day=1) - dt.timedelta(days=1)


CASES = {
    "monthly": (dict(freq="MONTHLY"), lambda s: lambda x: x.day == s.day, 1),
    "last weekday": (dict(freq="MONTHLY", by_weekday=(0, 1, 2, 3, 4), by_position=(-1,)), lambda s: lambda x: x.weekday() < 5, 1),
    "second and last friday": (dict(freq="MONTHLY", interval=2, by_weekday=((4, 2), (4, -1))), lambda s: lambda x: x.weekday() == 4 and (8 <= x.day <= 14 or x.day > _last(x).day - 7), 2),
    "ends": (dict(freq="MONTHLY", by_month_day=(1, -1, 31)), lambda s: lambda x: x.day in (1, 31) or x == _last(x), 1),
    "yearly": (dict(freq="YEARLY", interval=2), lambda s: lambda x: (x.month, x.day) == (s.month, s.day), 2),
    "thanksgiving": (dict(freq="YEARLY", by_month=(11,), by_weekday=((3, 4),)), lambda s: lambda x: x.month == 11 and x.weekday() == 3 and 22 <= x.day <= 28, 1),
    "year days": (dict(freq="YEARLY", by_year_day=(1, 100, -1)), lambda s: lambda x: x.timetuple().tm_yday in (1, 100) or (x.month, x.day) == (12, 31), 1),
    "year's last sunday": (dict(freq="YEARLY", by_weekday=((6, -1),)), lambda s: lambda x: x.weekday() == 6 and x.month == 12 and x.day > 24, 1),
    "weeks": (dict(freq="YEARLY", by_week=(1, 20, -1), by_weekday=(0,)), lambda s: lambda x: x.weekday() == 0 and (x.isocalendar()[1] in (1, 20) or x.isocalendar()[1] == dt.date(x.isocalendar()[0], 12, 28).isocalendar()[1]), 1),
    "fortnight": (dict(freq="WEEKLY", interval=2, by_weekday=(0, 3)), lambda s: lambda x: x.weekday() in (0, 3), 2),
    "weekly": (dict(freq="WEEKLY"), lambda s: lambda x: x.weekday() == s.weekday(), 1),
    "daily": (dict(freq="DAILY", interval=3, by_month=(1, 2)), lambda s: lambda x: x.month in (1, 2), 3),
    "positions": (dict(freq="YEARLY", by_month=(3, 4), by_weekday=(1,), by_position=(1, 3, -2)), lambda s: lambda x: x.month in (3, 4) and x.weekday() == 1, 1),
}


def test_recurrences_day_by_day(spark):
    starts = [dt.date(2023, 1, 31), dt.date(2024, 2, 29), dt.date(2020, 12, 28), dt.date(2021, 6, 15)]
    spans = [(s, s + dt.timedelta(days=d)) for s in starts for d in (0, 900)] + [(starts[0], starts[0] - dt.timedelta(days=1))]
    rows = spark.createDataFrame(spans, "a date, b date")
    got = rows.select("a", "b", *[R.occurrences(F.col("a"), F.col("b"), **how).alias(name) for name, (how, _, _) in CASES.items()]).collect()
    for r in got:
        for name, (how, passes, step) in CASES.items():
            want = _plain(r.a, r.b, how["freq"], passes(r.a), step, how.get("by_position", ())) if r.b >= r.a else []
            assert r[name] == want, (name, r.a, r.b)
    first = rows.filter("a = '2021-06-15' and b > '2022-01-01'").select(R.occurrences(F.col("a"), F.col("b"), "MONTHLY", count=3).alias("x")).first().x
    assert first == [dt.date(2021, 6, 15), dt.date(2021, 7, 15), dt.date(2021, 8, 15)]


def test_each_run_once_across_restarts(spark, tmp_path):
    path, out, bookmark = (str(tmp_path / x) for x in ("log", "out", "bookmark"))
    add = lambda *rows: log.append_events(spark.createDataFrame(rows, "ts long, run_id string, kind string, detail string"), path)
    add((1, "a", "run_start", None), (5, "a", "run_end", "{}"), (6, "b", "run_start", None))
    assert log.export_new_runs(spark, path, out, bookmark) == 1
    assert log.export_new_runs(spark, path, out, bookmark) == 0  # nothing new
    add((7, "b", "run_end", None), (8, "a", "run_end", "again"), (None, "c", "run_end", None))
    (tmp_path / "log/broken.txt").write_text('not json\n{"ts": 9, "run_id": "d", "kind": "run_end"}\n')
    assert log.export_new_runs(spark, path, out, bookmark) == 2
    got = sorted((r.run_id, r.ended_at) for r in log.exported_runs(spark, out).collect())
    assert got == [("a", 5), ("b", 7), ("d", 9)]
    lines = spark.read.text(path).filter("value like '%run_start%'").collect()
    assert sorted(r.value for r in lines)[0] == '{"ts":1,"run_id":"a","kind":"run_start","detail":null}'


def test_spans_share_one_computation(spark):
    days = [dt.date(2020, 1, 5), None, dt.date(2021, 3, 1)]
    rows = spark.createDataFrame([(k, days[k % 3], days[(k + k // 3) % 3]) for k in range(27)], "k int, s date, u date")
    how = dict(freq="MONTHLY", interval=2, by_month_day=(1, -1), count=5)
    got = R.by_span(rows, "s", "u", "at", **how)
    want = rows.withColumn("at", R.occurrences(F.col("s"), F.col("u"), **how))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "sequence" not in got._jdf.queryExecution().toString()  # nothing is computed a row


def test_a_line_is_read_once(spark):
    rows = spark.createDataFrame([("n", "numbered", NUMBERED)], "run string, format string, text string")
    plan = reports.test_outcomes(rows, "run")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("#[^:]*:") == 1 and plan.count("Passed|Failed") == 1


@pytest.mark.parametrize("name", ["dt_rrule_year_days", "dt_rrule_yearly"])
def test_recurrences_are_computed_by_span_not_by_order(spark, name):
    plan = registry.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence" not in plan


def test_rates_read_each_line_once(spark):
    plan = registry.queries()["prj_report_rates"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("#[^:]*:") == 1 and plan.count("Passed|Failed") == 1

"""Every query with SQL gives the same rows as DuckDB; every query runs."""

import pytest

from tests.conftest import DATA
from tidewell import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def _rows(names, rows):
    order = [names.index(n) for n in sorted(names)]
    return sorted(([r[i] for i in order] for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA), duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got.columns, got.collect()) == _rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0

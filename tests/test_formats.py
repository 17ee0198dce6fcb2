"""Headers, forms, tabs, Easter and matrix functions against plain versions."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidewell.functions import dates, matrix, texts


def test_header_options(spark):
    cases = {
        "Text/HTML": ("text/html", []),
        ' Form-Data; name="a"': ("Form-Data", [("name", "a")]),
        'form-data; name="a;b\\"c"; filename="C:\\\\dir\\\\f.txt"; x': ("form-data", [("name", 'a;b"c'), ("filename", "f.txt"), ("x", "")]),
        "a; B = c ;; filename*=utf-8''z; d=e=f": ("a", [("b", "c"), ("", ""), ("d", "e=f")]),
        'a; q="': ("a", [("q", '"')]),
        "a;": ("a", [("", "")]),
        ";": ("", [("", "")]),
        "": ("", []),
    }
    rows = spark.createDataFrame([(k,) for k in cases] + [(None,)], "h string")
    got = {r.h: r.o for r in rows.select("h", texts.header_options(F.col("h")).alias("o")).collect()}
    for h, (kind, options) in cases.items():
        assert (got[h].type, [tuple(x) for x in got[h].options]) == (kind, options), h
    assert got[None] is None


def test_query_pairs(spark):
    rows = spark.createDataFrame([("a=1&a=2;b&&c=&=d&e=f=g",), ("",), (None,)], "q string")
    got = [r.p for r in rows.select(texts.query_pairs(F.col("q")).alias("p")).collect()]
    assert [tuple(x) for x in got[0]] == [("a", "1"), ("a", "2"), ("b", None), ("c", ""), ("", "d"), ("e", "f=g")] and got[1] == [] and got[2] is None


@pytest.mark.parametrize("stop", [1, 4, 8])
def test_expand_tabs(spark, stop):
    cases = ["", "a\tb", "\t\ta\n\tb\tc\n", "é日\t😀\tx", "12345678\t9", "no tabs", "\n\n"]
    rows = spark.createDataFrame([(c,) for c in cases], "t string")
    for t, x, y in rows.select("t", texts.expand_tabs(F.col("t"), stop), texts.expand_tabs(F.col("t"), stop, False)).collect():
        assert y == t.expandtabs(stop) and x == (y if y.endswith("\n") else y + "\n")


def test_easter(spark):
    known = {2024: (dt.date(2024, 3, 31), dt.date(2024, 5, 5)), 1961: (dt.date(1961, 4, 2), dt.date(1961, 4, 9)), 2038: (dt.date(2038, 4, 25), dt.date(2038, 4, 25)), 1818: (dt.date(1818, 3, 22), dt.date(1818, 4, 26))}
    rows = spark.createDataFrame([(y,) for y in known] + [(0,)], "y int")
    got = rows.select("y", *[dates.easter(F.col("y"), m).alias(n) for m, n in ((3, "w"), (2, "o"), (1, "j"))]).collect()
    for r in got:
        if r.y:
            assert (r.w, r.o) == known[r.y] and r.o.weekday() == 6 and (r.o - r.j).days == r.y // 100 - r.y // 400 - 2
        else:
            assert r.w is r.o is r.j is None
    with pytest.raises(ValueError):
        dates.easter(F.lit(2000), 4)


def test_matrix_functions(spark):
    a = matrix.matrix(2, 3, F.array(*map(F.lit, (0.5, -0.25, 4.0, 1.0, 0.0, -2.5))))
    names = list(matrix.FUNCTIONS)
    row = spark.range(1).select(*[matrix.apply(a, n)["data"].alias(n) for n in names], matrix.least(a)["data"].alias("low"), matrix.most(a)["data"].alias("high"),
        matrix.element(a, 1, 2).alias("e"), matrix.element(a, 2).alias("first_row"), matrix.element(a, 2, 0).alias("out"), matrix.modulo(a, matrix.matrix(1, 1, F.array(F.lit(2.0))))["data"].alias("mod"), matrix.atan2(a, a)["data"].alias("at")).first()
    data = (0.5, -0.25, 4.0, 1.0, 0.0, -2.5)
    for n in names:
        f = {"ln": math.log, "log": math.log10, "abs": abs}.get(n) or getattr(math, n)
        for x, got in zip(data, row[n]):
            try:
                assert got == pytest.approx(f(x)), (n, x)
            except ValueError:
                assert math.isnan(got), (n, x)
    assert row.low == [0.5, -0.25, -2.5] and row.high == [1.0, 0.0, 4.0] and (row.e, row.first_row, row.out) == (-2.5, 4.0, None)
    assert row["mod"] == [math.fmod(x, 2.0) for x in data] and row["at"] == [math.atan2(x, x) for x in data]

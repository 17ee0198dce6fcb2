"""Outcomes of single tests from the text of test runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What the reports say, and the outcome that it is.
NODE_WORDS = (((" PASSED", " passed"), "pass"), ((" FAILED", " ERROR"), "fail"), ((" SKIPPED",), "skip"), ((" XFAIL",), "xfail"))
VERBS = {"Passed": "pass", "Failed": "fail", "Timeout": "timeout", "Not Run": "not_run", "Disabled": "skip"}
_SPACE = " \t\n\x0b\f\r"
SECTION, SECTION_VERBS = "The following tests FAILED", ("Passed", "Failed", "Timeout", "Not Run")


def _named(verb: Column, verbs) -> Column:
    return F.coalesce(*[F.when(verb == v, F.lit(VERBS[v])) for v in verbs])


def _verbose(line: Column) -> Column:
    """struct(test, outcome) of a line of a verbose run: a node id, with ::, and a word; the first kind of word that the line has decides."""
    first = F.regexp_extract(line, r"^(\S+)", 1)
    kind = F.coalesce(*[F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(line, w)), F.lit(name)) for words, name in NODE_WORDS])
    whole = kind.isin("pass", "fail") & F.contains(line, F.lit("::"))
    return F.when(whole | F.contains(first, F.lit("::")), F.struct(first.alias("test"), kind.alias("outcome")))


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _numbered(line: Column) -> Column:
    """struct(test, outcome) of a line "Test #n: name ..... verdict", whose last verb counts."""

    def of(rest: Column) -> Column:
        verb = F.regexp_extract(rest, rf"^.*({'|'.join(VERBS)})", 1)
        return F.struct(F.btrim(F.regexp_extract(rest, r"^\s*(\S+)", 1), F.lit(".")).alias("test"), _with(verb, lambda v: _named(v, VERBS)).alias("outcome"))

    rest = F.regexp_extract(line, r"^(?>.*?Test)\s*#[^:]*:(.*)$", 1)
    return F.when(F.contains(line, F.lit("Test")), _with(rest, of))


def _of_section(line: Column) -> Column:
    """struct(test, outcome) of a line "n - name (verdict)" of the list of failures."""
    at = r"^(?>.*? - )(.*) \((.*?)\)*$"
    verb = F.regexp_extract(line, at, 2)
    found = F.struct(F.trim(F.regexp_extract(line, at, 1)).alias("test"), _with(verb, lambda v: _named(v, SECTION_VERBS)).alias("outcome"))
    return F.when(F.contains(line, F.lit(" - ")), found)


def test_outcomes(reports: DataFrame, run: str) -> DataFrame:
    """run, test, outcome (pass, fail, timeout, not_run, skip, xfail) of each test that a run's reports name.

    reports: run, format ("verbose" or "numbered"), text; part (optional) orders a run's
    reports. A test's last line counts; in a numbered report the list of failures at its
    end, from where on nothing else does. Lines that name no test or no outcome are passed
    over, so a null or empty text gives nothing. A report is exploded to its lines, and
    a row a test is kept before anything is shuffled.
    """
    part = F.col("part") if "part" in reports.columns else F.lit(0)
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(_SPACE)))
    split = reports.select(run, "format", part.alias("part"), lines.alias("lines"))
    begin = F.array_position(F.transform("lines", lambda x: F.startswith(x, F.lit(SECTION))), True)
    split = split.select(run, "format", "part", begin.alias("begin"), "lines")

    def said(line: Column, at: Column) -> Column:
        listed = (F.col("begin") > 0) & (at >= F.col("begin"))
        return F.when(F.col("format") == "verbose", _verbose(line)).when(listed, _of_section(line)).otherwise(_numbered(line))

    # a line is read once, in the array: of a row a line, what is read would be computed for each of its uses
    rows = split.select(run, "part", F.posexplode(F.transform("lines", said)).alias("at", "s"))
    found = rows.select(run, F.struct("part", "at").alias("at"), "s").filter("s.test <> '' and s.outcome is not null")
    last = found.groupBy(run, F.col("s.test").alias("test")).agg(F.max_by("s.outcome", "at").alias("outcome"))
    return last.select(run, "test", "outcome")

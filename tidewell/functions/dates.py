"""Church dates as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

JULIAN, ORTHODOX, WESTERN = 1, 2, 3


def _over(a: Column, n: int) -> Column:
    return F.floor(a / n)


def _in_march(year: Column, n: Column) -> Column:
    """The n-th day counted from the first of March."""
    return F.date_add(F.make_date(year, F.lit(3), F.lit(1)), (n - 1).cast("int"))


def _julian(year: Column) -> Column:
    """Days of March (more than 31 are in April) of Easter in the Julian calendar: the Sunday after the full moon."""
    moon = (19 * (year % 19) + 15) % 30
    return 28 + moon - (year + _over(year, 4) + moon) % 7


def _western(year: Column) -> Column:
    """The same in the Gregorian calendar: by the golden number, the century's corrections, and the epact."""
    golden, century = year % 19 + 1, _over(year, 100) + 1
    leaps, lunar = _over(3 * century, 4) - 12, _over(8 * century + 5, 25) - 5
    epact = F.pmod(11 * golden + 20 + lunar - leaps, F.lit(30))
    epact = epact + F.when((epact == 25) & (golden > 11) | (epact == 24), 1).otherwise(0)
    moon = 44 - epact
    moon = moon + F.when(moon < 21, 30).otherwise(0)
    return moon + 7 - (_over(5 * year, 4) - leaps - 10 + moon) % 7


def easter(year: Column, method: int = WESTERN) -> Column:
    """Easter Sunday: by the Julian calendar and in its terms, the same Sunday in Gregorian terms (from 1583 on), or by the
    Gregorian calendar. NULL before year 1."""
    if method not in (JULIAN, ORTHODOX, WESTERN):
        raise ValueError("method is JULIAN, ORTHODOX or WESTERN")
    year = year.cast("long")
    behind = _over(year, 100) - _over(year, 400) - 2  # days that the Julian calendar is behind
    n = {JULIAN: _julian, ORTHODOX: lambda y: _julian(y) + behind, WESTERN: _western}[method](year)
    return F.when(year >= 1, _in_march(year.cast("int"), n))

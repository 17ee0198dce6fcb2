"""Recurring dates: by-filters over a calendar as columns, positions within a period as ranks, all in arrays of a row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.sources.session import ensure_checkpoint_dir

MONDAY, TUESDAY, WEDNESDAY, THURSDAY, FRIDAY, SATURDAY, SUNDAY = range(7)
#: Spans sent to every executor (a few dates each), and tasks that compute them.
FEW_SPANS, TASKS = 100_000, 32
_UNIT = {"YEARLY": "YEARS", "MONTHLY": "MONTHS", "WEEKLY": "DAYS", "DAILY": "DAYS"}


def _ceil7(n: Column) -> Column:
    return F.floor((n + 6) / 7)


def _is_in(values, *numbers: Column) -> Column:
    """Whether any of the numbers (one counted from the front, one from the back) is a value."""
    return reduce(lambda a, b: a | b, [n.isin(*values) for n in numbers])


def _nth(day: Column, n_of: list[tuple[int, int]], in_month: bool) -> Column:
    """Whether the day is the n-th of its weekday in its month or year, from the back for negative n."""
    place = F.dayofmonth(day) if in_month else F.dayofyear(day)
    length = F.dayofmonth(F.last_day(day)) if in_month else F.dayofyear(F.make_date(F.year(day), F.lit(12), F.lit(31)))
    front, back = _ceil7(place), -_ceil7(length - place + 1)
    return reduce(lambda a, b: a | b, [(F.weekday(day) == w) & ((front if n > 0 else back) == n) for w, n in n_of])


def _week(day: Column) -> tuple[Column, Column]:
    """Number of the day's ISO week, from the front and from the back of its year."""
    year = F.extract(F.lit("YEAROFWEEK"), day)
    weeks = F.weekofyear(F.make_date(year, F.lit(12), F.lit(28)))
    return F.weekofyear(day), F.weekofyear(day) - weeks - 1


def occurrences(
    start: Column,
    until: Column,
    freq: str,
    interval: int = 1,
    count: int | None = None,
    by_month: tuple[int, ...] = (),
    by_month_day: tuple[int, ...] = (),
    by_weekday: tuple = (),
    by_year_day: tuple[int, ...] = (),
    by_week: tuple[int, ...] = (),
    by_position: tuple[int, ...] = (),
    week_start: int = MONDAY,
) -> Column:
    """array of the dates of a recurrence from start on, up to and with until, in order.

    freq: YEARLY, MONTHLY, WEEKLY or DAILY; every interval-th period counts, from the one
    that start is in. A period's days are those that pass all filters; a weekday may be a
    pair with n, for the n-th in the month (of MONTHLY, and of YEARLY with by_month) or year;
    without a filter for days they are those like start. Of a period's days by_position
    keeps those at these places, from the back if negative. count is of dates from start
    on. Null dates give NULL; until before start gives no date.
    """
    plain = [w for w in by_weekday if isinstance(w, int)] + [w[0] for w in by_weekday if not isinstance(w, int) and freq in ("WEEKLY", "DAILY")]
    nth = [w for w in by_weekday if not isinstance(w, int) and freq not in ("WEEKLY", "DAILY")]
    any_day = bool(by_month_day or by_weekday or by_year_day or by_week)

    def passes(day: Column) -> Column:
        tests = []
        if by_month:
            tests.append(F.month(day).isin(*by_month))
        if by_month_day:
            tests.append(_is_in(by_month_day, F.dayofmonth(day), F.dayofmonth(day) - F.dayofmonth(F.last_day(day)) - 1))
        if by_year_day:
            last = F.dayofyear(F.make_date(F.year(day), F.lit(12), F.lit(31)))
            tests.append(_is_in(by_year_day, F.dayofyear(day), F.dayofyear(day) - last - 1))
        if by_week:
            tests.append(_is_in(by_week, *_week(day)))
        if plain:
            tests.append(F.weekday(day).isin(*plain))
        if nth:
            tests.append(_nth(day, nth, freq == "MONTHLY" or bool(by_month)))
        if not any_day:
            if freq == "YEARLY" and not by_month:
                tests.append(F.month(day) == F.month(start))
            if freq in ("YEARLY", "MONTHLY"):
                tests.append(F.dayofmonth(day) == F.dayofmonth(start))
            if freq == "WEEKLY":
                tests.append(F.weekday(day) == F.weekday(start))
        return reduce(lambda a, b: a & b, tests, F.lit(True))

    back = F.pmod(F.weekday(start) - week_start, F.lit(7)).cast("int")
    first = {"YEARLY": F.trunc(start, "year"), "MONTHLY": F.trunc(start, "month"), "WEEKLY": F.date_sub(start, back), "DAILY": start}[freq]
    step = F.expr(f"INTERVAL {interval * (7 if freq == 'WEEKLY' else 1)} {_UNIT[freq]}")
    end = {
        "YEARLY": lambda p: F.make_date(F.year(p), F.lit(12), F.lit(31)),
        "MONTHLY": F.last_day,
        "WEEKLY": lambda p: F.date_add(p, 6),
        "DAILY": lambda p: p,
    }[freq]

    def of_period(p: Column) -> Column:
        days = F.filter(F.sequence(p, end(p)), passes)
        if not by_position:
            return days
        picked = F.transform(F.array(*map(F.lit, by_position)), lambda n: F.get(days, F.when(n > 0, n - 1).otherwise(F.size(days) + n)))
        return F.array_sort(F.array_distinct(F.filter(picked, lambda x: x.isNotNull())))

    dates = F.flatten(F.transform(F.sequence(first, until, step), of_period))
    dates = F.filter(dates, lambda x: (x >= start) & (x <= until))
    if count is not None:
        dates = F.slice(dates, 1, count)
    return F.when(until >= start, dates).when(until < start, F.array().cast("array<date>"))


def by_span(rows: DataFrame, start: str, until: str, name: str, **how) -> DataFrame:
    """rows with the occurrences between the dates in two columns, as a column of that name.

    Rows with equal dates share one computation: of few days there are as many spans,
    however many rows there are.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    spans = rows.select(F.col(start).alias("_start"), F.col(until).alias("_until")).dropna().distinct().repartition(TASKS, "_start", "_until")
    spans = spans.withColumn(name, occurrences(F.col("_start"), F.col("_until"), **how)).checkpoint()
    spans = F.broadcast(spans) if spans.count() <= FEW_SPANS else spans
    return rows.join(spans, (F.col(start) == F.col("_start")) & (F.col(until) == F.col("_until")), "left").drop("_start", "_until")

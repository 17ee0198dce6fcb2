"""Recurring dates from each order's date on."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import recurrence as R
from tidewell.registry import query
from tidewell.sources.tables import table

#: Every day of the two years after an order's date, by the order's period.
_DAYS = """o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + {n} AS u FROM orders),
  c AS (SELECT CAST(unnest(generate_series((SELECT min(s) FROM o) - INTERVAL 400 DAY, (SELECT max(u) FROM o) + INTERVAL 400 DAY, INTERVAL 1 DAY)) AS DATE) AS d)"""


def _between(spark, d, days, **how):
    day = F.to_date("o_orderdate")
    orders = table(spark, d, "orders").select("o_orderkey", day.alias("start"), F.date_add(day, days).alias("until"))
    return R.by_span(orders, "start", "until", "dates", **how).select("o_orderkey", F.explode("dates").alias("at"))


@query(
    "dt_rrule_month_ends",
    f"""WITH {_DAYS.format(n=365)}, m AS (SELECT date_trunc('month', d) AS m, max(d) AS d FROM c WHERE isodow(d) < 6 GROUP BY 1)
        SELECT o_orderkey, d AS at FROM o JOIN m ON d BETWEEN s AND u""",
)
def dt_rrule_month_ends(spark, d):
    """The last weekday of each month."""
    return _between(spark, d, 365, freq="MONTHLY", by_weekday=(0, 1, 2, 3, 4), by_position=(-1,))


@query(
    "dt_rrule_monthly",
    f"""WITH {_DAYS.format(n=500)} SELECT o_orderkey, d AS at FROM o JOIN c ON d BETWEEN s AND u AND (year(d) * 12 + month(d) - year(s) * 12 - month(s)) % 2 = 0
          AND (day(d) IN (1, 15, 31) OR d = last_day(d))""",
)
def dt_rrule_monthly(spark, d):
    """Of every other month the first, the fifteenth, the thirty-first and the last day."""
    return _between(spark, d, 500, freq="MONTHLY", interval=2, by_month_day=(1, 15, 31, -1))


@query(
    "dt_rrule_yearly",
    f"""WITH {_DAYS.format(n=1000)}, n AS (SELECT d, isodow(d) AS w, month(d) AS m, row_number() OVER (PARTITION BY year(d), month(d), isodow(d) ORDER BY d) AS first,
            row_number() OVER (PARTITION BY year(d), month(d), isodow(d) ORDER BY d DESC) AS last FROM c)
        SELECT o_orderkey, d AS at FROM o JOIN n ON d BETWEEN s AND u AND (m IN (3, 11) AND (w = 4 AND first = 4 OR w = 7 AND last = 1))""",
)
def dt_rrule_yearly(spark, d):
    """The fourth Thursday and the last Sunday of March and November."""
    return _between(spark, d, 1000, freq="YEARLY", by_month=(3, 11), by_weekday=((3, 4), (6, -1)))


@query(
    "dt_rrule_positions",
    f"""WITH {_DAYS.format(n=1200)}, n AS (SELECT d, row_number() OVER (PARTITION BY year(d) ORDER BY d) AS f, row_number() OVER (PARTITION BY year(d) ORDER BY d DESC) AS b FROM c WHERE month(d) IN (4, 5) AND isodow(d) = 2)
        SELECT o_orderkey, d AS at FROM o JOIN n ON d BETWEEN s AND u AND (f IN (1, 3) OR b = 2)""",
)
def dt_rrule_positions(spark, d):
    """Of the Tuesdays of April and May each year's first, third and last but one."""
    return _between(spark, d, 1200, freq="YEARLY", by_month=(4, 5), by_weekday=(1,), by_position=(1, 3, -2))


@query(
    "dt_rrule_weeks",
    f"""WITH {_DAYS.format(n=200)}, r AS (SELECT o_orderkey, d, row_number() OVER (PARTITION BY o_orderkey ORDER BY d) AS k FROM o JOIN c ON d BETWEEN s AND u
          AND (CAST(date_trunc('week', d) AS DATE) - CAST(date_trunc('week', s) AS DATE)) % 14 = 0 AND isodow(d) IN (1, 4))
        SELECT o_orderkey, d AS at FROM r WHERE k <= 7""",
)
def dt_rrule_weeks(spark, d):
    """Seven Mondays and Thursdays of every other week."""
    return _between(spark, d, 200, freq="WEEKLY", interval=2, by_weekday=(0, 3), count=7)


@query(
    "dt_rrule_year_days",
    f"""WITH {_DAYS.format(n=800)} SELECT o_orderkey, d AS at FROM o JOIN c ON d BETWEEN s AND u AND (weekofyear(d) IN (1, 20) AND isodow(d) = 1)""",
)
def dt_rrule_year_days(spark, d):
    """The Mondays of the weeks 1 and 20."""
    return _between(spark, d, 800, freq="YEARLY", by_week=(1, 20), by_weekday=(0,))

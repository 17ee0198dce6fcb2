"""Interval sets by customer: when orders were open, and when their items were under way."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import intervals
from tidewell.registry import query
from tidewell.sources.tables import table


def _open_orders(spark, d):
    """From an order's date on, 0 to 30 days; ends open or closed by the key, some unbounded; those of no days may be empty."""
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select(
        "o_custkey",
        F.when(F.col("o_orderkey") % 401 != 0, day).alias("lo"), F.when(F.col("o_orderkey") % 403 != 0, F.date_add(day, (F.col("o_orderkey") % 31).cast("int"))).alias("hi"),
        (F.col("o_orderkey") % 2 == 0).alias("lo_in"), (F.col("o_orderkey") % 3 == 0).alias("hi_in"),
    )


def _under_way(spark, d):
    """Up to an item's ship date, as many days as its line's number and quantity say."""
    day = F.to_date("l_shipdate")
    items = table(spark, d, "lineitem").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    return items.select(
        "o_custkey", F.date_sub(day, (F.col("l_linenumber") * 3 + F.col("l_quantity")).cast("int")).alias("lo"), day.alias("hi"),
        (F.col("l_partkey") % 2 == 0).alias("lo_in"), (F.col("l_suppkey") % 3 > 0).alias("hi_in"),
    )


#: In the SQL a cut is a number: twice the day, plus one if above it; the outermost ones are far away.
_SQL = """WITH a AS (
    SELECT o_custkey, CASE WHEN o_orderkey % 401 = 0 THEN -1000000 ELSE 2 * d + CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 1 END END AS x,
      CASE WHEN o_orderkey % 403 = 0 THEN 1000000 ELSE 2 * (d + o_orderkey % 31) + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END END AS y
    FROM (SELECT *, CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS d FROM orders)),
  b AS (
    SELECT o_custkey, 2 * (d - CAST(l_linenumber * 3 + l_quantity AS INT)) + l_partkey % 2 AS x, 2 * d + CASE WHEN l_suppkey % 3 > 0 THEN 1 ELSE 0 END AS y
    FROM (SELECT *, CAST(l_shipdate AS DATE) - DATE '1970-01-01' AS d FROM lineitem) JOIN orders ON l_orderkey = o_orderkey),
  points AS (
    SELECT DISTINCT o_custkey, unnest([-1000000, x, y, 1000000]) AS p FROM (SELECT * FROM a UNION ALL SELECT * FROM {second})),
  cells AS (SELECT o_custkey, p AS x, lead(p) OVER (PARTITION BY o_custkey ORDER BY p) AS y FROM points),
  inside AS (
    SELECT c.o_custkey, c.x, c.y FROM cells c WHERE c.y IS NOT NULL
      AND {holds}),
  islands AS (
    SELECT *, sum(fresh) OVER (PARTITION BY o_custkey ORDER BY x) AS island
    FROM (SELECT *, CASE WHEN x = lag(y) OVER (PARTITION BY o_custkey ORDER BY x) THEN 0 ELSE 1 END AS fresh FROM inside)),
  merged AS (SELECT o_custkey, min(x) AS x, max(y) AS y FROM islands GROUP BY o_custkey, island)"""
_DAY = "CAST(CASE WHEN abs({c}) < 1000000 THEN DATE '1970-01-01' + CAST(({c} - ({c} % 2 + 2) % 2) // 2 AS INT) END AS DATE)"
_ROWS = f"""
  SELECT o_custkey, {_DAY.format(c="x")} AS lo, {_DAY.format(c="y")} AS hi, abs(x) < 1000000 AND x % 2 = 0 AS lo_in, abs(y) < 1000000 AND y % 2 <> 0 AS hi_in FROM merged"""
_IN = "EXISTS (SELECT 1 FROM {t} i WHERE i.o_custkey = c.o_custkey AND i.x <= c.x AND i.y >= c.y AND i.x < i.y)"
_A, _B = _IN.format(t="a"), _IN.format(t="b")


def _sql(holds: str, second: str = "b") -> str:
    return _SQL.format(holds=holds, second=second) + _ROWS


@query("set_union_ranges", _sql(f"({_A} OR {_B})"))
def set_union_ranges(spark, d):
    return intervals.union(_open_orders(spark, d), _under_way(spark, d), ["o_custkey"])


@query("set_intersect_ranges", _sql(f"({_A} AND {_B})"))
def set_intersect_ranges(spark, d):
    return intervals.intersection(_open_orders(spark, d), _under_way(spark, d), ["o_custkey"])


@query("set_subtract_ranges", _sql(f"({_A} AND NOT {_B})"))
def set_subtract_ranges(spark, d):
    return intervals.difference(_open_orders(spark, d), _under_way(spark, d), ["o_custkey"])


@query("set_complement_ranges", _sql(f"NOT {_A}", "a"))
def set_complement_ranges(spark, d):
    return intervals.complement(_open_orders(spark, d), ["o_custkey"])


@query(
    "set_compare_ranges",
    _SQL.format(holds="TRUE", second="b")
    + f""", facts AS (SELECT o_custkey, {_A} AS in_a, {_B} AS in_b FROM cells c WHERE y IS NOT NULL)
  SELECT o_custkey, count(*) FILTER (in_a AND NOT in_b) = 0 AS is_subset, count(*) FILTER (in_b AND NOT in_a) = 0 AS is_superset,
    count(*) FILTER (in_a AND in_b) = 0 AS is_disjoint FROM facts GROUP BY 1""",
)
def set_compare_ranges(spark, d):
    return intervals.relations(_open_orders(spark, d), _under_way(spark, d), ["o_custkey"])

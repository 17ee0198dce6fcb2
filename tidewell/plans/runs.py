"""Test reports and the event log, made of the driver's tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import gates, reports
from tidewell.registry import query
from tidewell.sources.session import scratch
from tidewell.sources.tables import table
from tidewell.streaming import log

_ITEMS = """i AS (
    SELECT l_orderkey, l_linenumber, l_partkey % 50 AS t, l_orderkey % 2 = 0 AS even, CAST(l_suppkey % 5 AS INT) AS k, CAST(l_quantity AS BIGINT) % 4 = 0 AS listed FROM lineitem),
  said AS (
    SELECT l_orderkey, CASE WHEN even THEN 'tests/m' || t || '.py::test_passed' ELSE 'case_' || t || '_Failed' END AS test, l_linenumber * 5 + k AS pos,
      CASE WHEN even THEN (['pass', 'fail', 'fail', 'skip', 'xfail'])[k + 1] ELSE (['pass', 'fail', 'timeout', 'not_run', 'skip'])[k + 1] END AS outcome FROM i
    UNION ALL
    SELECT l_orderkey, 'case_' || t || '_Failed', 100 + l_linenumber * 5, (['fail', 'timeout'])[CAST(t % 2 + 1 AS INT)] FROM i WHERE NOT even AND listed),
  outcomes AS (SELECT l_orderkey, test, (list(outcome ORDER BY pos DESC))[1] AS outcome FROM said GROUP BY 1, 2)"""


def _reports(spark, d):
    """A report an order, a line an item; verbose ones of even orders, numbered ones, with a list of failures, of the others."""
    i = table(spark, d, "lineitem")
    t, k = F.col("l_partkey") % 50, (F.col("l_suppkey") % 5 + 1).cast("int")
    verbose = F.concat(
        F.lit("tests/m"), t, F.lit(".py::test_passed"),
        F.element_at(F.array(*map(F.lit, (" PASSED   [ 10%]", " FAILED", " ERROR", " SKIPPED (no)", " XFAIL"))), k),
    )
    numbered = F.concat(
        F.col("l_linenumber"), F.lit("/9 Test  #"), F.col("l_linenumber"), F.lit(": case_"), t, F.lit("_Failed ......"),
        F.element_at(F.array(*map(F.lit, ("   Passed  0.1 sec", "***Failed  0.1 sec", "***Timeout 9 sec", "***Not Run", "***Failed then Disabled"))), k),
    )
    failure = F.concat(F.lit("\t "), F.col("l_linenumber"), F.lit(" - case_"), t, F.lit("_Failed ("), F.when(t % 2 == 0, "Failed").otherwise("Timeout"), F.lit(")"))
    even = F.col("l_orderkey") % 2 == 0
    lines = i.groupBy("l_orderkey").agg(  # an order's few items
        F.sort_array(F.collect_list(F.struct("l_linenumber", k.alias("k"), F.when(even, verbose).otherwise(numbered).alias("line")))).alias("a"),
        F.sort_array(F.collect_list(F.when(F.col("l_quantity").cast("long") % 4 == 0, F.struct("l_linenumber", failure.alias("line"))))).alias("b"),
    )
    text = F.array_join(F.col("a.line"), "\r\n")
    tail = F.concat(F.lit("\nThe following tests FAILED:\n"), F.array_join(F.col("b.line"), "\n"))
    return lines.select(
        "l_orderkey", F.when(even, "verbose").otherwise("numbered").alias("format"), F.concat(F.lit("collected 9 items\n"), text, F.when(even, "\n== 3 passed ==").otherwise(tail)).alias("text")
    )


@query("prj_test_outcomes", f"WITH {_ITEMS} SELECT * FROM outcomes")
def prj_test_outcomes(spark, d):
    return reports.test_outcomes(_reports(spark, d), "l_orderkey")


@query(
    "prj_report_rates",
    f"""WITH {_ITEMS} SELECT l_orderkey, count(*) FILTER (outcome = 'pass') AS passed, count(*) FILTER (outcome IN ('fail', 'timeout')) AS failed,
        count(*) FILTER (outcome <> 'not_run') AS total, CASE WHEN count(*) FILTER (outcome <> 'not_run') = 0 THEN 1.0 ELSE count(*) FILTER (outcome = 'pass') / count(*) FILTER (outcome <> 'not_run') END AS pass_rate
        FROM outcomes GROUP BY 1""",
)
def prj_report_rates(spark, d):
    return gates.rates(reports.test_outcomes(_reports(spark, d), "l_orderkey"), "l_orderkey")


@query(
    "prj_report_known",
    f"""WITH {_ITEMS}, g AS (SELECT l_orderkey, count(*) FILTER (outcome IN ('pass', 'fail', 'timeout')) AS ran, count(*) FILTER (outcome IN ('fail', 'timeout')) AS n_failed,
          count(*) FILTER (outcome IN ('fail', 'timeout') AND NOT contains(test, '7')) AS n_extras FROM outcomes GROUP BY 1)
        SELECT l_orderkey, ran > 0 AND n_extras = 0 AS passed, CASE WHEN ran = 0 THEN 'empty_run' WHEN n_extras > 0 THEN 'failures_beyond_known' END AS reason, n_failed, n_extras FROM g""",
)
def prj_report_known(spark, d):
    """Tests with a 7 in their number are known to fail."""
    numbers = table(spark, d, "part").select((F.col("p_partkey") % 50).cast("string").alias("t")).distinct().filter("t like '%7%'")
    known = numbers.select(F.explode(F.array(F.concat(F.lit("tests/m"), "t", F.lit(".py::test_passed")), F.concat(F.lit("case_"), "t", F.lit("_Failed")))).alias("name"))
    found = reports.test_outcomes(_reports(spark, d), "l_orderkey").withColumnRenamed("test", "name")
    return gates.parity_with_known(found, known, "l_orderkey")


@query(
    "st_export_runs",
    """WITH e AS (SELECT 'u' || user_id AS run_id, event_type, CAST(epoch(ts) AS BIGINT) AS at, day(ts) > 15 AS late FROM events WHERE event_type IN ('purchase', 'error'))
       SELECT run_id, bool_or(NOT late) AS first_call, CAST(count(DISTINCT run_id) AS BIGINT) AS times FROM e WHERE event_type = 'purchase' GROUP BY 1""",
)
def st_export_runs(spark, d):
    """The events of the month's first half are logged and exported, then the others: each run comes once, with the call that saw its first end."""
    e = table(spark, d, "events").filter(F.col("event_type").isin("purchase", "error"))
    rows = e.select(
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"), F.concat(F.lit("u"), "user_id").alias("run_id"),
        F.when(F.col("event_type") == "purchase", "run_end").otherwise("error").alias("kind"), F.col("props").alias("detail"), (F.dayofmonth("ts") > 15).alias("late"),
    )
    path, out, bookmark = (scratch(spark, x) for x in ("log", "runs", "bookmark"))
    for late in (False, True):
        log.append_events(rows.filter(F.col("late") == late), path)
        log.export_new_runs(spark, path, out, bookmark)
        if not late:
            first = log.exported_runs(spark, out).agg(F.max("batch")).first()[0]
    got = log.exported_runs(spark, out)
    return got.groupBy("run_id").agg((F.min("batch") <= (-1 if first is None else first)).alias("first_call"), F.count(F.lit(1)).alias("times"))

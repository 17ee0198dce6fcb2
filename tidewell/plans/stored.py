"""The ledger's tables made of the driver's, appended to a fresh ledger and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.registry import query
from tidewell.sources import ledger
from tidewell.sources.session import scratch
from tidewell.sources.tables import table


@query(
    "snk_hunks",
    """SELECT coalesce(reason, 'stored') AS reason, count(*) AS n, count(gain) AS measured, CAST(sum(stamp) AS BIGINT) AS recorded FROM (
         SELECT l_orderkey AS stamp, CASE WHEN l_partkey % 3 = 0 THEN l_tax END AS gain, CASE WHEN l_orderkey % 7 = 0 THEN 'run_id must be non-empty' WHEN l_suppkey % 11 = 0 THEN 'unit_id must be non-empty' WHEN l_partkey % 13 = 0 THEN 'before_ref must be non-empty'
           WHEN l_linenumber = 7 THEN 'verdict must be non-empty' END AS reason FROM lineitem) GROUP BY 1""",
)
def snk_hunks(spark, d):
    """Line items as hunks: some without a run, unit, reference or verdict are rejected; unmeasured ones stay NULL."""
    i = table(spark, d, "lineitem")
    text = lambda c, bad, empty="": F.when(bad, F.lit(empty)).otherwise(c.cast("string"))
    hunks = i.select(
        text(F.col("l_orderkey"), F.col("l_orderkey") % 7 == 0).alias("run_id"), text(F.col("l_suppkey"), F.col("l_suppkey") % 11 == 0, None).alias("unit_id"),
        F.lit("p").alias("package"), F.lit("s").alias("source"), text(F.col("l_partkey"), F.col("l_partkey") % 13 == 0).alias("before_ref"), F.lit("b").alias("after_ref"),
        F.when(F.col("l_partkey") % 3 == 0, F.col("l_tax")).alias("wall_delta_pct"), text(F.col("l_returnflag"), F.col("l_linenumber") == 7).alias("verdict"),
        F.col("l_orderkey").alias("recorded_at"),
    )
    path = scratch(spark, "ledger")
    ledger.append_rows(hunks, path, "hunks")
    stored = ledger.read_table(spark, path, "hunks").select(F.lit("stored").alias("reason"), "wall_delta_pct", "recorded_at")
    every = stored.union(ledger.read_rejects(spark, path, "hunks").select("reason", "wall_delta_pct", "recorded_at"))
    return every.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.count("wall_delta_pct").alias("measured"), F.sum("recorded_at").alias("recorded"))


@query(
    "src_ledger_tables",
    """SELECT 'units' AS name, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END) AS BIGINT) AS tokens, count(*) FILTER (o_orderkey % 2 = 0) AS filled FROM orders
       UNION ALL SELECT 'optimizations', count(*), CAST(sum(l_linenumber) AS BIGINT), count(*) FROM lineitem WHERE l_returnflag <> 'R'
       UNION ALL SELECT 'failed_optimizations', count(*), CAST(sum(l_linenumber) AS BIGINT), count(*) FROM lineitem WHERE l_returnflag = 'R'
       UNION ALL SELECT 'rounds', 0, NULL, 0""",
)
def src_ledger_tables(spark, d):
    """Tables as an older version wrote them, without later columns; units are NULL here and there; rounds were never written."""
    path = scratch(spark, "ledger")
    key = F.col("o_orderkey")
    units = table(spark, d, "orders").select(
        key.cast("string").alias("id"), F.col("o_custkey").cast("string").alias("run_id"), F.lit("fix").alias("kind"), F.lit("{}").alias("spec_json"),
        F.when(key % 2 == 1, "[1]").alias("depends_on"), F.lit("passed").alias("status"), F.when(key % 3 != 0, F.col("o_custkey")).alias("tokens_in"),
    )
    units.write.parquet(f"{path}/units")
    i = table(spark, d, "lineitem")
    common = [
        F.col("l_partkey").alias("id"), F.col("l_orderkey").cast("string").alias("run_id"), F.col("l_linenumber").alias("round"), F.lit("h").alias("hotspot"), F.lit("t").alias("technique"),
        F.col("l_linenumber").alias("tokens_spent"), F.lit(7).alias("not_known"),
    ]
    i.filter("l_returnflag <> 'R'").select(*common, F.lit("c").alias("commit_sha"), F.lit(1.0).alias("delta_pct")).write.parquet(f"{path}/optimizations")
    i.filter("l_returnflag = 'R'").select(*common, F.lit("no_gain").alias("outcome")).write.parquet(f"{path}/failed_optimizations")
    filled = {"units": F.col("depends_on") == "[]", "optimizations": (F.col("harvest_class") == "") & (F.col("patch_text") == "") & (F.col("tier") == 0), "failed_optimizations": F.col("patch_text") == ""}
    tokens = {"units": "tokens_in", "optimizations": "tokens_spent", "failed_optimizations": "tokens_spent"}
    out = None
    for name in ("units", "optimizations", "failed_optimizations", "rounds"):
        t = ledger.read_table(spark, path, name)
        sums = F.sum(tokens[name]) if name in tokens else F.lit(None).cast("long")
        row = t.agg(F.count(F.lit(1)).alias("n"), sums.alias("tokens"), F.count_if(filled.get(name, F.lit(False))).alias("filled")).select(F.lit(name).alias("name"), "n", "tokens", "filled")
        out = row if out is None else out.unionByName(row)
    return out

"""Evidence documents made of each order, so that the oracle states what is read of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.registry import query
from tidewell.sources import evidence as E
from tidewell.sources.tables import table

_BOOL = "CASE WHEN o_orderkey % {} = 0 THEN 'true' ELSE 'false' END"
_DOCS = {
    "verification": f"""'{{"zeta":{{"passed":' || {_BOOL.format(2)} || '}},"note":{{"n":1}},"python_install_smoke":[{{"passed":' || {_BOOL.format(3)} || '}},{{}}]'
        || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE ',"passed":' || {_BOOL.format(7)} END || '}}'""",
    "verdict": """'{"unit":"u' || CAST(o_orderkey AS STRING) || '","verdict":' || CASE o_orderkey % 3 WHEN 0 THEN '"admit"' WHEN 1 THEN '{"refuse":["a' || CAST(o_custkey AS STRING) || '","b","c","d"]}'
        ELSE '{"odd":1}' END || '}'""",
    "grade": f"""'{{"integrity":{{"passed":' || {_BOOL.format(2)} || ',"detail":{{"test_count":' || CAST(o_custkey AS STRING) || '}}}},"failed_tests":["t' || CAST(o_orderkey AS STRING) || '"]'
        || CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE ',"parity":{{"passed":true,"detail":{{"failed":3}}}}' END || '}}'""",
    "scope": "'{\"scope_verdict\":' || CASE WHEN o_orderkey % 2 = 0 THEN '\"in' || CAST(o_custkey AS STRING) || '\"' ELSE 'null' END || '}'",
}


@query(
    "src_evidence",
    """SELECT o_orderkey, o_orderkey % 5 <> 0 AND o_orderkey % 7 = 0 AS passed,
         'python_install_smoke[0]=' || (o_orderkey % 3 = 0) || ',python_install_smoke[1]=false,zeta=' || (o_orderkey % 2 = 0) AS stages,
         CASE o_orderkey % 3 WHEN 0 THEN 'admit' WHEN 1 THEN 'refuse' ELSE 'unknown' END AS verdict,
         CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'refuse[4]; a' || o_custkey || '; b; c' ELSE 'unshaped verdict: {"odd":1}' END AS evidence,
         o_orderkey % 2 = 0 AS integrity, o_custkey AS tests, o_orderkey % 4 <> 0 AS parity, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 3 END AS failed, 't' || o_orderkey AS names FROM orders""",
)
def src_evidence(spark, d):
    read = table(spark, d, "orders").select(
        "o_orderkey",
        E.verification(F.expr(_DOCS["verification"])).alias("v"),
        E.gate_verdict(F.expr(_DOCS["verdict"])).alias("g"),
        E.scoped_grade(F.expr(_DOCS["grade"])).alias("s"),
    )
    stages = F.transform("v.stages", lambda x: F.concat(x["name"], F.lit("="), x["passed"].cast("string")))
    return read.select(
        "o_orderkey", "v.passed", F.array_join(stages, ",").alias("stages"), "g.verdict", "g.evidence", F.col("s.integrity_passed").alias("integrity"),
        F.col("s.integrity_tests").alias("tests"), F.col("s.parity_passed").alias("parity"), F.col("s.parity_failed").alias("failed"),
        F.array_join("s.failed_tests", ",").alias("names"),
    )


@query("prj_scope", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'in' || o_custkey END AS verdict FROM orders")
def prj_scope(spark, d):
    return table(spark, d, "orders").select("o_orderkey", E.scope_verdict(F.expr(_DOCS["scope"])).alias("verdict"))

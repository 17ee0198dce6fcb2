"""Dependency graphs, bound to parts: a part depends on those at half and a third of its key."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import graph
from tidewell.registry import query
from tidewell.sources.session import ensure_checkpoint_dir
from tidewell.sources.tables import table

_EDGES = """edges AS (SELECT p_partkey AS u, p_partkey // 2 AS v FROM part WHERE p_partkey % 2 = 0 AND p_partkey > 2
            UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey % 3 = 0 AND p_partkey > 3)"""


def _edges(spark, d):
    p = table(spark, d, "part").select("p_partkey")
    two = p.filter("p_partkey % 2 = 0 AND p_partkey > 2").selectExpr("p_partkey AS dependent", "p_partkey DIV 2 AS dependency")
    return two.union(p.filter("p_partkey % 3 = 0 AND p_partkey > 3").selectExpr("p_partkey", "p_partkey DIV 3")).distinct()


@query(
    "gr_levels",
    f"""WITH RECURSIVE {_EDGES}, walk AS (SELECT DISTINCT v AS node, 0 AS level FROM edges WHERE v NOT IN (SELECT u FROM edges)
        UNION SELECT edges.u, walk.level + 1 FROM walk JOIN edges ON edges.v = walk.node)
        SELECT node, max(level) AS level FROM walk GROUP BY 1""",
)
def gr_levels(spark, d):
    ensure_checkpoint_dir(spark)
    return graph.levels(_edges(spark, d))


@query(
    "gr_forgiving",
    f"""WITH {_EDGES} SELECT u AS dependent, v AS dependency FROM edges WHERE u NOT IN (6, 12)""",
)
def gr_forgiving(spark, d):
    """The parts' dependencies with two that close cycles: all edges of 6, then of 12, go before theirs do."""
    ensure_checkpoint_dir(spark)
    more = spark.createDataFrame([(6, 12), (12, 24)], "dependent long, dependency long")
    return graph.without_cycles(_edges(spark, d).union(more))[0]


@query(
    "gr_verify",
    f"WITH {_EDGES} SELECT bool_and(v < u) AS holds FROM edges",
)
def gr_verify(spark, d):
    order = table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_partkey").alias("pos"))
    return graph.order_holds(_edges(spark, d), order)


@query(
    "gr_dag",
    f"WITH {_EDGES} SELECT u AS node, array_to_string(list_sort(list(DISTINCT v)), ',') AS needs FROM edges GROUP BY 1",
)
def gr_dag(spark, d):
    sets = _edges(spark, d).groupBy(F.col("dependent").alias("node")).agg(F.array_sort(F.collect_set("dependency")).alias("n"))
    return sets.select("node", F.array_join(F.transform("n", lambda x: x.cast("string")), ",").alias("needs"))

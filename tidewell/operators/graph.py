"""Dependency graphs as frames of (dependent, dependency) edges."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def levels(edges: DataFrame, most: int | None = None) -> DataFrame:
    """node, level: 0 for what depends on nothing, else 1 more than its highest dependency.

    A step a level: the dependents of the nodes that the step before reached. What a
    step reaches is written; a node's level is the last step that reached it. An edge
    list with a cycle is an error, as its levels never end; chains may have any length,
    or most steps, if that is given.
    """
    e = edges.select(F.col("dependent").alias("u"), F.col("dependency").alias("v")).distinct().checkpoint()
    nodes = e.select("u").union(e.select("v")).distinct()
    reached = [nodes.select(F.col("u").alias("node"), F.lit(0).alias("level"))]
    front = e.select(F.col("v").alias("node")).distinct().join(e, F.col("node") == F.col("u"), "left_anti").checkpoint()
    if not _stuck(e).isEmpty():
        raise ValueError("the dependencies have a cycle")
    for step in itertools.count(1):
        if most is not None and step > most:
            raise ValueError(f"the dependencies have a chain of over {most}")
        front = e.join(front, F.col("v") == F.col("node"), "left_semi").select(F.col("u").alias("node")).distinct().checkpoint()
        if front.isEmpty():
            every = reached[0]
            for x in reached[1:]:
                every = every.union(x)
            return every.groupBy("node").agg(F.max("level").alias("level"))
        reached.append(front.select("node", F.lit(step).alias("level")))


def _stuck(e: DataFrame) -> DataFrame:
    """Edges (u, v) that are left when those to nodes without dependencies are taken away, again and again."""
    while True:
        rest = e.join(e.select(F.col("u").alias("n")).distinct(), F.col("v") == F.col("n"), "left_semi").checkpoint()
        if rest.count() == e.count():
            return rest
        e = rest


def without_cycles(edges: DataFrame) -> tuple[DataFrame, list[tuple]]:
    """Edges (dependent, dependency) without those that close cycles, and these in the order in which they go.

    Nodes whose dependencies are done are done in turn; where none is left, the smallest
    edge of a node that is not done goes, and so on. A step a pass, a pass an edge that goes.
    """
    kept = edges.select(F.col("dependent").alias("u"), F.col("dependency").alias("v")).distinct().checkpoint()
    stuck, gone = _stuck(kept), []
    while not stuck.isEmpty():
        u, v = kept.join(stuck.select("u").distinct(), "u", "left_semi").orderBy("u", "v").first()
        gone.append((u, v))
        other = ~((F.col("u") == u) & (F.col("v") == v))
        kept, stuck = kept.filter(other).checkpoint(), _stuck(stuck.filter(other))
    return kept.select(F.col("u").alias("dependent"), F.col("v").alias("dependency")), gone


def order_holds(edges: DataFrame, order: DataFrame) -> DataFrame:
    """One row: do all dependencies come before their dependents in (node, pos)? Unknown nodes break the order."""
    a = order.select(F.col("node").alias("a"), F.col("pos").alias("pa"))
    b = order.select(F.col("node").alias("b"), F.col("pos").alias("pb"))
    j = edges.join(a, F.col("dependent") == F.col("a"), "left").join(b, F.col("dependency") == F.col("b"), "left")
    return j.agg(F.coalesce(F.every(F.coalesce(F.col("pb") < F.col("pa"), F.lit(False))), F.lit(True)).alias("holds"))

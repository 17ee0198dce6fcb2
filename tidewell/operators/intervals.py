"""Interval sets as rows: union, intersection, difference, complement, subset, disjoint, by a sweep over endpoints.

A set is what the rows of a group have: lo, hi (null: unbounded), lo_in, hi_in (whether
the end belongs to it; null: not). An end is a cut just below or just above its value, so that
an interval is what lies between two cuts, and one whose cuts are not in order is empty.

The sweep runs the depths of both operands over the cuts of all sets. Where the operation's
truth changes, a result interval begins or ends. Groups of up to LARGE intervals are dealt
whole, in one shuffle of the intervals; the cuts of larger ones by ranges of group and cut
(operators/ranking.py), so that no task holds such a group. Results are disjoint, and no two
of them touch.

Groups may be null. A group that only one operand has is compared with the empty set. Repeated
and overlapping intervals count once. Empty operands give what the empty set gives.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.ranking import running_totals
from tidewell.sources.session import ensure_checkpoint_dir, materialize

_LOW, _VALUE, _HIGH = -1, 0, 1
#: Intervals of a group that one task sorts.
LARGE = 500_000


def _cut(value: Column, above: Column, unbounded: int) -> Column:
    """Where a set begins or ends: below all values, just below or just above a value, or above all."""
    known = value.isNotNull()
    return F.struct(
        F.when(known, _VALUE).otherwise(unbounded).cast("int").alias("zone"), value.alias("value"), (known & F.coalesce(above, F.lit(False))).alias("above")
    )


def _outer(kind: str) -> list[Column]:
    value = F.lit(None).cast(kind)
    return [F.struct(_cut(value, F.lit(False), z).alias("cut"), F.lit(0).alias("by")) for z in (_LOW, _HIGH)]


def _cuts(sets: DataFrame, group: list[str], bounded: bool) -> DataFrame:
    """group, cut and the change of the operands' depths there, a row an end; the outermost cuts too, of empty intervals or, unless bounded, of all."""
    kind = sets.schema["lo"].dataType.simpleString()
    lower, upper = _cut(F.col("lo"), ~F.coalesce("lo_in", F.lit(False)), _LOW), _cut(F.col("hi"), F.col("hi_in"), _HIGH)
    inner = [F.struct(F.col("a").alias("cut"), F.lit(1).alias("by")), F.struct(F.col("b").alias("cut"), F.lit(-1).alias("by"))]
    ends = F.when(F.col("a") < F.col("b"), F.array(*inner, *([] if bounded else _outer(kind)))).otherwise(F.array(*_outer(kind)))
    rows = sets.select(*group, "second", lower.alias("a"), upper.alias("b")).select(*group, "second", F.explode(ends).alias("e"))
    by = F.col("e.by").cast("long")
    return rows.select(*group, F.col("e.cut").alias("cut"), F.when(~F.col("second"), by).otherwise(0).alias("x"), F.when(F.col("second"), by).otherwise(0).alias("y"))


def _split(a: DataFrame, b: DataFrame | None, group: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """The operands' intervals as one frame, second telling whose: those of groups that a task can hold, and of larger ones, if there are any."""
    kept = [*group, "lo", "hi", "lo_in", "hi_in"]
    rows = a.select(*kept, F.lit(False).alias("second"))
    if b is not None:
        rows = rows.unionByName(b.select(*kept, F.lit(True).alias("second")))
    rows = materialize(rows, "intervals")
    names = {g: f"_of_{k}" for k, g in enumerate(group)}
    large = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > LARGE).withColumnsRenamed(names)
    large = materialize(large, "large")  # one in LARGE intervals at most
    if large.isEmpty():
        return rows, None
    same = F.lit(True)
    for g, of in names.items():
        same &= F.col(g).eqNullSafe(F.col(of))
    return rows.join(F.broadcast(large), same, "left_anti"), rows.join(F.broadcast(large), same, "left_semi")


def _states(sets: DataFrame, group: list[str], bounded: bool) -> DataFrame:
    """group, cut, in_x, in_y: whether what follows a cut is in the operands; sets are dealt by group and sorted, once."""
    cuts = _cuts(sets.repartition(*group) if group else sets.coalesce(1), group, bounded)
    by_cut = Window.partitionBy(*group).orderBy("cut")
    so_far = by_cut.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = cuts.select(*group, "cut", F.sum("x").over(so_far).alias("x"), F.sum("y").over(so_far).alias("y"), F.lead("cut").over(by_cut).alias("next"))
    last = cuts.filter("next is null or next <> cut")
    return last.select(*group, "cut", (F.col("x") > 0).alias("in_x"), (F.col("y") > 0).alias("in_y"))


def _states_of_large(sets: DataFrame, group: list[str], bounded: bool) -> DataFrame:
    """The same, by ranges of group and cut."""
    cuts = _cuts(sets, group, bounded).groupBy(*group, "cut").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    cuts = running_totals(cuts, group, [F.col("cut")], {"x_before": F.col("x"), "y_before": F.col("y")})
    return cuts.select(*group, "cut", (F.col("x_before") + F.col("x") > 0).alias("in_x"), (F.col("y_before") + F.col("y") > 0).alias("in_y"))


def sweep(a: DataFrame, b: DataFrame | None, group: list[str], holds: Callable[[Column, Column], Column], bounded: bool = True) -> DataFrame:
    """group, lo, hi, lo_in, hi_in: where holds(in a, in b) is true; bounded unless that is so outside of both."""
    ensure_checkpoint_dir(a.sparkSession)
    small, large = _split(a, b, group)
    now = (holds(F.col("in_x"), F.col("in_y")) & (F.col("cut.zone") < _HIGH)).alias("is")
    by_cut = Window.partitionBy(*group).orderBy("cut")
    states = _states(small, group, bounded).select(*group, "cut", now)
    edges = states.withColumn("was", F.lag("is", 1, False).over(by_cut)).filter("was <> is")
    pairs = edges.select(*group, F.col("cut").alias("a"), F.lead("cut").over(by_cut).alias("b"), "is").filter("is").drop("is")
    if large is not None:
        pairs = pairs.union(_pairs_of_large(_states_of_large(large, group, bounded).select(*group, "cut", now), group))
    bounded_at = lambda c: F.col(f"{c}.zone") == _VALUE
    return pairs.select(
        *group,
        F.col("a.value").alias("lo"), F.col("b.value").alias("hi"),
        (bounded_at("a") & ~F.col("a.above")).alias("lo_in"), (bounded_at("b") & F.col("b.above")).alias("hi_in"),
    )


def _pairs_of_large(states: DataFrame, group: list[str]) -> DataFrame:
    """group, a, b: where the truth begins and ends; of cuts that begin or go on, the n-th belongs with the n-th end."""
    # a run of true states begins at its first cut: the number of false ones before is the run's
    runs = running_totals(states, group, [F.col("cut")], {"n": (~F.col("is")).cast("long")})
    runs = runs.groupBy(*group, "n").agg(F.min(F.when(F.col("is"), F.col("cut"))).alias("a"), F.min(F.when(~F.col("is"), F.col("cut"))).alias("b"))
    return runs.filter("a is not null").select(*group, "a", "b")


def union(a: DataFrame, b: DataFrame, group: list[str]) -> DataFrame:
    return sweep(a, b, group, lambda x, y: x | y)


def merged(a: DataFrame, group: list[str]) -> DataFrame:
    """The set itself, as disjoint intervals."""
    return sweep(a, None, group, lambda x, y: x)


def intersection(a: DataFrame, b: DataFrame, group: list[str]) -> DataFrame:
    return sweep(a, b, group, lambda x, y: x & y)


def difference(a: DataFrame, b: DataFrame, group: list[str]) -> DataFrame:
    return sweep(a, b, group, lambda x, y: x & ~y)


def complement(a: DataFrame, group: list[str]) -> DataFrame:
    """What the set leaves out; of a group whose intervals are all empty, everything."""
    return sweep(a, None, group, lambda x, y: ~x, bounded=False)


def relations(a: DataFrame, b: DataFrame, group: list[str]) -> DataFrame:
    """group, is_subset (a in b), is_superset, is_disjoint, for every group of either, by one sweep."""
    ensure_checkpoint_dir(a.sparkSession)
    small, large = _split(a, b, group)
    states = _states(small, group, True)
    if large is not None:
        states = states.union(_states_of_large(large, group, True))
    x, y = F.col("in_x"), F.col("in_y")
    none = lambda holds: F.count_if(holds & (F.col("cut.zone") < _HIGH)) == 0
    return states.groupBy(*group).agg(none(x & ~y).alias("is_subset"), none(y & ~x).alias("is_superset"), none(x & y).alias("is_disjoint"))

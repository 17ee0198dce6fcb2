"""Ranks and running totals without a task for a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.sources.session import materialize

#: Up to so many offsets (a few numbers and the group's values each) are sent to every executor, and so many rows are
#: summed by plain windows.
FEW = 100_000


def running_totals(rows: DataFrame, group: list[str], order: list[Column], values: dict[str, Column]) -> DataFrame:
    """rows with the sums of values over the rows before, in order within the group, as columns of those names.

    Rows are dealt by ranges of group and order and written, so that a large group lies
    in many partitions; each partition sums its own, and what the partitions before hold
    of the group is added. Where there are few rows in all, that would cost more than it
    saves. Order must leave no ties that matter. Groups may be NULL.
    """
    dealt = materialize(rows.withColumns({f"_value_{k}": v for k, v in enumerate(values.values())}), "rows")
    if dealt.count() <= FEW:
        all_before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return dealt.select(*rows.columns, *[F.coalesce(F.sum(f"_value_{k}").over(all_before), F.lit(0)).alias(n) for k, n in enumerate(values)])
    dealt = dealt.repartitionByRange(*[F.col(g) for g in group], *order)
    dealt = materialize(dealt.withColumn("_part", F.spark_partition_id()), "dealt")
    which = range(len(values))
    sums = dealt.groupBy(*group, "_part").agg(*[F.sum(f"_value_{k}").alias(f"_sum_{k}") for k in which])
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    names = {g: f"_of_{k}" for k, g in enumerate(group)}
    offsets = sums.withColumns({f"_offset_{k}": F.coalesce(F.sum(f"_sum_{k}").over(before), F.lit(0)) for k in which})
    offsets = materialize(offsets.drop(*[f"_sum_{k}" for k in which]).withColumnsRenamed(names | {"_part": "_in"}), "offsets")
    same = F.col("_part") == F.col("_in")
    for g, of in names.items():
        same &= F.col(g).eqNullSafe(F.col(of))
    here = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumns({f"_local_{k}": F.coalesce(F.sum(f"_value_{k}").over(here), F.lit(0)) for k in which})
    joined = local.join(F.broadcast(offsets) if offsets.count() <= FEW else offsets, same)
    return joined.select(*rows.columns, *[(F.col(f"_local_{k}") + F.col(f"_offset_{k}")).alias(name) for k, name in enumerate(values)])


def running_total(rows: DataFrame, group: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """rows with the sum of one value over the rows before, as running_totals()."""
    return running_totals(rows, group, order, {name: value})


def row_numbers(rows: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """rows with their number from 1, in order within the group."""
    return running_total(rows, group, order, F.lit(1), name).withColumn(name, F.col(name).cast("int") + 1)

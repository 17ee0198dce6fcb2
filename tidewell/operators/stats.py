"""Statistics with the ledger's conventions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators.ranking import row_numbers, running_total


def upper_median(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Element n/2 of each group's values in order, without interpolation.

    Values are counted first, so a group is its distinct values with running
    counts, not an array of all its rows.
    """
    from pyspark.sql import Window

    counts = rows.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(group)
    reached = F.sum("n").over(w.orderBy(value))
    return (
        counts.withColumn("reached", reached)
        .withColumn("all", F.sum("n").over(w))
        .filter(F.col("reached") > F.floor(F.col("all") / 2))
        .groupBy(group)
        .agg(F.min(value).alias("median"))
    )


def tukey_fences(rows: DataFrame, group: str, value: str, width: float = 3.0) -> DataFrame:
    """group, low, high: fences beyond the quartiles (linear between ranks); NULL for groups of under four values.

    From counts by distinct value and their running totals: no group is held whole.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(group, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    totals = rows.groupBy(F.col(group).alias("g")).agg(F.count(value).alias("n"))
    placed = running_total(counts, [group], [F.col("v")], F.col("c"), "before")
    placed = placed.join(totals, F.col(group).eqNullSafe(F.col("g")), "right")

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("c")), F.col("v")))

    last = F.col("n") - 1
    quartiles = placed.groupBy("g", "n").agg(
        *[f(F.floor(last * q) if low else F.ceil(last * q)).alias(f"{name}{i}") for i, q in enumerate((0.25, 0.75))
          for name, low, f in (("low", True, at), ("high", False, at))]
    )
    a, b = (F.col(f"low{i}") + (F.col(f"high{i}") - F.col(f"low{i}")) * (last * q - F.floor(last * q)) for i, q in enumerate((0.25, 0.75)))
    enough = F.col("n") >= 4
    return quartiles.select(
        F.col("g").alias(group), F.when(enough, a - width * (b - a)).alias("low"), F.when(enough, b + width * (b - a)).alias("high")
    )


def noise(a: Column, b: Column) -> Column:
    """Difference over the mean; 0 where the mean is not positive."""
    mean = (a + b) / 2
    return F.when(mean > 0, F.abs(a - b) / mean).otherwise(0.0)


#: Fixed values of the resampling stream: seed, multiplier, increment, resamples, ranks of the interval.
_SEED, _MUL, _INC, _TIMES, _LOW, _HIGH = 0x123456789ABCDEF0, 6364136223846793005, 1442695040888963407, 1000, 25, 974


#: Values of a group to a block, blocks that a task holds (16 million values, 128 MB), resamples that it draws, and states that it draws at once.
_BLOCK, _HELD, _DRAWS, _CHUNK = 100_000, 160, 50, 1 << 18


def _stream(state: int, n: int) -> np.ndarray:
    """The next n states after one, by doubling."""
    out = np.array([(state * _MUL + _INC) % (1 << 64)], np.uint64)
    mul, inc = _MUL, _INC  # what leads as many steps on as out is long
    with np.errstate(over="ignore"):
        while len(out) < n:
            out = np.concatenate([out, out * np.uint64(mul) + np.uint64(inc)])
            mul, inc = mul * mul % (1 << 64), (mul * inc + inc) % (1 << 64)
    return out[:n]


def _ahead(state: int, steps: int) -> int:
    """The state so many steps after one."""
    mul, inc = _MUL, _INC
    while steps:
        if steps & 1:
            state = (state * mul + inc) % (1 << 64)
        mul, inc = mul * mul % (1 << 64), (mul * inc + inc) % (1 << 64)
        steps >>= 1
    return state


def _leap(steps: int) -> tuple[int, int]:
    """Multiplier and increment that lead so many steps on."""
    inc = _ahead(0, steps)
    return (_ahead(1, steps) - inc) % (1 << 64), inc


def _draw(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums of the picks that fall in the blocks held, for the resamples of a draw."""
    rows = rows.sort_values("block")
    g, n, draw, low = rows["g"].iloc[0], int(rows["n"].iloc[0]), int(rows["draw"].iloc[0]), int(rows["block"].iloc[0]) * _BLOCK
    x = np.concatenate([np.asarray(v, float) for v in rows["values"]])
    size, sums = min(_CHUNK, n), np.zeros(_DRAWS)
    mul, inc = map(np.uint64, _leap(size))
    for k in range(_DRAWS):
        states = _stream(_ahead(_SEED, (draw * _DRAWS + k) * n), size)
        for at in range(0, n, size):
            picks = (states[: n - at] >> np.uint64(33)).astype(np.uint32)
            if n < 1 << 31:
                picks -= picks // np.uint32(n) * np.uint32(n)
            if len(x) < n:
                picks = picks[(picks >= low) & (picks < low + len(x))].astype(np.int64) - low
            sums[k] += x[picks].sum()
            with np.errstate(over="ignore"):
                states *= mul
                states += inc
    return pd.DataFrame({"g": g, "n": n, "resample": draw * _DRAWS + np.arange(_DRAWS), "sum": sums})


def bootstrap_interval(rows: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """group, low, high, point: interval of resampled means of each group's measurements, in order.

    Resamples are drawn in tasks of their own, each from its place in the random stream.
    A group's values lie in blocks; a draw sums its picks of _HELD blocks, whose states are
    drawn once, and the sums are added, so that no task holds more than these. Groups must
    not be NULL.
    """
    kind = rows.schema[group].dataType.simpleString()
    ranked = row_numbers(rows.select(group, order, F.col(value).cast("double").alias("x")), [group], [F.col(order)], "pos")
    sizes = ranked.groupBy(F.col(group).alias("g")).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("point"))
    blocks = ranked.withColumn("block", F.floor((F.col("pos") - 1) / _BLOCK)).groupBy(F.col(group).alias("b_g"), "block")
    blocks = blocks.agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("rows"))
    blocks = blocks.select("b_g", "block", F.transform("rows", lambda r: r["x"]).alias("values"))
    draws = blocks.join(sizes, F.col("b_g") == F.col("g")).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(_TIMES // _DRAWS - 1))))
    draws = draws.select("g", "n", "block", "draw", "values").groupBy("g", "draw", F.floor(F.col("block") / _HELD))
    sums = draws.applyInPandas(_draw, f"g {kind}, n long, resample long, sum double")
    means = sums.groupBy("g", "resample").agg((F.sum("sum") / F.max("n")).alias("mean"))
    means = means.groupBy(F.col("g").alias("m_g")).agg(F.sort_array(F.collect_list("mean")).alias("m"))  # _TIMES numbers
    return means.join(sizes, F.col("m_g") == F.col("g")).select(
        F.col("g").alias(group), F.col("m")[_LOW].alias("low"), F.col("m")[_HIGH].alias("high"), "point"
    )

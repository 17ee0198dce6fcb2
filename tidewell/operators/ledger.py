"""Relational operators of the evidence ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def yield_by(done: DataFrame, failed: DataFrame, keys: list[str], gain: str) -> DataFrame:
    """Attempts and mean known gain by key, over both outcomes."""
    both = done.select(*keys, gain).unionByName(failed.select(*keys, gain))
    return both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(gain).alias("avg_gain"))


def ratio_of_sums(top: str | Column, bottom: str | Column) -> Column:
    """Sum over sum; NULL where the lower sum is 0."""
    low = F.sum(bottom)
    return F.sum(top) / F.when(low != 0, low)


def keep_first(frames: list[DataFrame], key: str) -> DataFrame:
    """Union of frames, of each key the row of the first frame that has it; adds src_ord."""
    both = None
    for k, f in enumerate(frames):
        f = f.withColumn("src_ord", F.lit(k))
        both = f if both is None else both.unionByName(f)
    cols = [c for c in both.columns if c != key]
    best = F.min_by(F.struct(*cols), "src_ord").alias("r")  # partial aggregation: no window over a hot key
    return both.groupBy(key).agg(best).select(key, "r.*")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of old, replaced by those of new with the same key, and new keys."""
    return keep_first([new, old], key).drop("src_ord")


def insert_ignore(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of old, and those of new whose key old lacks."""
    return old.unionByName(new.join(old.select(key), key, "left_anti"))


def fold_updates(changes: DataFrame, key: str, ts: str, last: dict[str, str], first: dict[str, str]) -> DataFrame:
    """State by key from change rows: the last value of some columns, the first of others."""
    aggs = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(ts))).alias(n) for n, c in last.items()]
    aggs += [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(ts))).alias(n) for n, c in first.items()]
    return changes.groupBy(key).agg(*aggs)


def compare_pairs(expected: DataFrame, actual: DataFrame, key: str, values: list[str]) -> DataFrame:
    """total, matched, mismatched, missing of expected keys; NULL equals NULL, further actual keys don't count."""
    a = actual.select(F.col(key).alias("_k"), *[F.col(v).alias(f"_{v}") for v in values], F.lit(True).alias("_there"))
    same = F.lit(True)
    for v in values:
        same &= F.col(v).eqNullSafe(F.col(f"_{v}"))
    j = expected.join(a, F.col(key) == F.col("_k"), "left")
    there = F.col("_there").isNotNull()
    return j.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(there & same).alias("matched"),
        F.count_if(there & ~same).alias("mismatched"),
        F.count_if(~there).alias("missing"),
    )


def lookup_with_fallback(
    rows: DataFrame, exact: DataFrame, loose: DataFrame, exact_on: list[str], loose_on: list[str], value: str
) -> DataFrame:
    """rows with value from the exact table, even a NULL one; only where it has no row, from the loose table."""
    e = exact.select(*[F.col(c).alias(f"e_{c}") for c in exact_on], F.col(value).alias("e_value"), F.lit(True).alias("e_hit"))
    o = loose.select(*[F.col(c).alias(f"o_{c}") for c in loose_on], F.col(value).alias("o_value"))
    j = rows
    for t, on, p in ((e, exact_on, "e_"), (o, loose_on, "o_")):
        cond = F.lit(True)
        for c in on:
            cond &= F.col(c) == F.col(p + c)
        j = j.join(t, cond, "left")
    got = F.when(F.col("e_hit").isNotNull(), F.col("e_value")).otherwise(F.col("o_value"))
    return j.select(*rows.columns, got.alias(value))


def nest(rows: DataFrame, key: str, order: list[str], fields: list[str], name: str) -> DataFrame:
    """Rows of a key as one array of structs in order."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *fields))).alias(name))


def first_failing(rows: DataFrame, key: str, order: str, label: str, passed: Column) -> DataFrame:
    """key, all_passed, and the label of the first row in order that didn't pass."""
    return rows.groupBy(key).agg(
        F.every(passed).alias("all_passed"), F.min_by(label, F.when(~passed, F.col(order))).alias("first_failed")
    )


def dominant(rows: DataFrame, group: str, label: str, amount: str) -> DataFrame:
    """Of each group the label with the greatest amount (the lowest label among equals), its amount and the total."""
    per = rows.groupBy(group, label).agg(F.sum(amount).alias("amount"))
    # the lowest label of the greatest amount: least of (-amount, label)
    best = F.min(F.struct((-F.col("amount")).alias("neg"), F.col(label).alias("label")))
    return per.groupBy(group).agg(best.alias("b"), F.sum("amount").alias("total")).select(
        group, F.col("b.label").alias("dominant"), (-F.col("b.neg")).alias("amount"), "total"
    )


def best_ratio(rows: DataFrame, failed: DataFrame, on: list[str], top: Column, cost: Column, at_least: Column, n: int, tie: str) -> DataFrame:
    """The n untried candidates of greatest top / cost, of those that reach a threshold."""
    left = rows.filter(at_least).join(failed.select(*on).distinct(), on, "left_anti")
    return left.withColumn("ratio", top / cost).orderBy(F.col("ratio").desc(), tie).limit(n)


def compound_by_day(rows: DataFrame, day: str, pct: str) -> DataFrame:
    """day, compound: product of (1 + pct/100) - 1 of all days up to it. Rows are days, already summed."""
    w = Window.orderBy(day).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select(day, (F.product(1 + F.col(pct) / 100).over(w) - 1).alias("compound"))


def vote(rows: DataFrame, motion: str, seat: str, stance: str, deciding_seat: Column) -> DataFrame:
    """consensus where all stances agree, else the deciding seat's stance."""
    return rows.groupBy(motion).agg(
        (F.min(stance) == F.max(stance)).alias("consensus"),
        F.count(F.lit(1)).alias("votes"),
        F.coalesce(F.when(F.min(stance) == F.max(stance), F.min(stance)), F.max(F.when(deciding_seat, F.col(stance)))).alias("decision"),
    )

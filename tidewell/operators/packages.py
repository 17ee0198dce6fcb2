"""Candidate packages: a path by the first rule that holds, a payoff, and ranks within sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators.ranking import row_numbers

#: Curated verdicts in the order in which they decide, with their path; sizes of a surface in lines.
CURATED = (("full", "adopt"), ("noop", "adopt"), ("upstream", "upstream"))
LARGE_SURFACE, TRIVIAL_SURFACE = 2000, 1000


def distinct_words(*lists: Column) -> Column:
    """How many different words the lists have together; a null list has none."""
    none = F.array().cast("array<string>")
    return F.size(F.array_distinct(F.flatten(F.array(*[F.coalesce(x, none) for x in lists]))))


def classify(packages: DataFrame, by: str) -> DataFrame:
    """by, path, reason, payoff of packages.

    packages: by, downloads, verdicts (curated, or empty), py_lines, native_files,
    native_build, words, summary_words (of its archive; py_lines is NULL where none
    was seen), filters (curated dispositions in order), headroom (a probe's disposition,
    or NULL).

    The first rule that holds decides: a curated verdict, in the order of CURATED; native
    code that is built around a large surface (upstream); a trivial surface without native
    files or words (adopt); else mirror. A mirror's payoff is its downloads in millions times
    one more than its distinct words, or the downloads alone where no archive was seen.
    Then the first filter alone counts, and on a mirror only: upstream_only takes it
    there, exclude and demote stay with it as its section; a probe counts where there is no
    filter, and cannot demote.
    """
    seen = F.col("py_lines").isNotNull()
    words = distinct_words(F.col("words"), F.col("summary_words"))
    curated = [F.when(F.array_contains("verdicts", v), F.struct(F.lit(p).alias("path"), F.lit(v).alias("reason"))) for v, p in CURATED]
    rule = lambda when, path, reason: F.when(when, F.struct(F.lit(path).alias("path"), F.lit(reason).alias("reason")))
    native = seen & (F.col("native_files") > 0) & F.col("native_build") & (F.col("py_lines") >= LARGE_SURFACE)
    trivial = seen & (F.col("py_lines") < TRIVIAL_SURFACE) & (words == 0) & (F.col("native_files") == 0)
    found = F.coalesce(*curated, rule(native, "upstream", "native_build"), rule(trivial, "adopt", "trivial"), rule(F.lit(True), "mirror", "no_equivalent"))
    rows = packages.select(
        by, found.alias("r"), (F.col("downloads") / 1e6 * F.when(seen, 1 + words).otherwise(1)).alias("worth"),
        F.get("filters", F.lit(0)).alias("first"), F.when(F.size("filters") > 0, F.lit(None)).otherwise(F.col("headroom")).alias("probe"),
    )
    acts = F.when(F.col("r.path") == "mirror", F.coalesce("first", F.when(F.col("probe") != "demote", F.col("probe"))))
    path = F.when(acts == "upstream_only", "upstream").otherwise(F.col("r.path"))
    reason = F.when(acts == "upstream_only", F.when(F.col("first").isNotNull(), "filter").otherwise("headroom")).otherwise(F.col("r.reason"))
    section = F.when(path == "mirror", F.when(acts == "exclude", "excluded").when(acts == "demote", "demoted").otherwise("clean"))
    return rows.select(by, path.alias("path"), reason.alias("reason"), section.alias("section"), F.when(path == "mirror", F.col("worth")).alias("payoff"))


def ranked(classified: DataFrame, by: str) -> DataFrame:
    """classified with rank: by payoff within the clean and the demoted mirrors, equal ones by name; others have none."""
    open_ = F.col("section").isin("clean", "demoted")
    counted = row_numbers(classified.filter(open_), ["section"], [F.col("payoff").desc(), F.col(by)], "rank")
    return counted.unionByName(classified.filter(~F.coalesce(open_, F.lit(False))).withColumn("rank", F.lit(None).cast("int")))

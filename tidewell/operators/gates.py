"""Verdicts of gates, as columns: struct(passed, reason), or NULL reason where the gate passes.

A gate's numbers enter as columns, so that a whole ledger is judged in one projection;
what several rows decide (pairs of a campaign, tests of a run) is an aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A claim's least size, and how much more memory, allocations, binary and compile time a change may take (per cent).
NOISE, RESOURCE_LIMITS = 0.01, {"rss": 5.0, "alloc": 10.0, "binary": 10.0, "compile": 20.0}


def _verdict(*failures: tuple[Column, str]) -> Column:
    """The first failure that holds is the reason."""
    reason = F.coalesce(*[F.when(c, F.lit(r)) for c, r in failures])
    return F.struct(reason.isNull().alias("passed"), reason.alias("reason"))


def heldout_divergence(visible: Column, heldout: Column, threshold: Column) -> Column:
    """Passes strictly under the threshold."""
    return _verdict((~(visible - heldout < threshold), "divergence_over_threshold"))


def workload_divergence(visible: Column, heldout: Column, threshold: float = 0.10, floor: float = 0.0) -> Column:
    return _verdict(((visible - heldout > threshold) | (heldout < -floor), "rejected_for_workload_divergence"))


def causal_attribution(with_change: Column, without: Column, floor: Column) -> Column:
    """The gain must go with the change: what is left is within the floor, or half of it at most."""
    gone = (F.abs(without) <= floor) | (F.abs(without) <= 0.5 * F.greatest(F.abs(with_change), F.lit(1e-9)))
    return _verdict((~gone, "gain_persists_without_change"))


def no_regression(base: dict[str, Column], got: dict[str, Column], others_ok: Column, heldout_ok: Column) -> Column:
    """base, got: rss, alloc (may be NULL: not measured, not judged), binary, compile. From nothing, nothing is more."""
    more = {
        k: F.when(base[k] <= 0, F.lit(0.0)).otherwise((got[k] - base[k]) / base[k] * 100) for k in RESOURCE_LIMITS
    }
    return _verdict(
        (~others_ok, "other_workload_regressed"),
        (~heldout_ok, "heldout_regressed"),
        *[(F.coalesce(more[k] > most, F.lit(False)), f"{k}_regression") for k, most in RESOURCE_LIMITS.items()],
    )


def benchmark_restated(gain: Column, floor: Column, low: Column, high: Column, sign: Column) -> Column:
    """low, high: the interval of wall time, NULL where there is none; it must clear the noise and agree in sign."""
    has, apart = low.isNotNull(), (low > 0) | (high < 0)
    clear = (low > NOISE) | (high < -NOISE)
    wall = F.when(low > NOISE, 1.0).otherwise(-1.0)
    return _verdict(
        (gain <= floor, "below_floor"),
        (has & ~apart, "ci_includes_zero"),
        (has & ~clear, "ci_inside_noise_threshold"),
        (has & (wall * sign < 0), "instrument_disagreement"),
    )


def unsafe_budget(sites: Column, budget_pct: Column, files: Column) -> Column:
    """sites: array of struct(ffi, commented). All at a boundary and commented, and not more than the share of files, rounded up."""
    allowed = F.greatest(F.ceil(budget_pct / 100 * files), F.when(budget_pct > 0, 1).otherwise(0))
    first = F.filter(sites, lambda s: ~s["ffi"] | ~s["commented"])
    return _verdict(
        ((F.size(first) > 0) & ~F.get(first, F.lit(0))["ffi"], "unsafe_not_at_ffi"),
        (F.size(first) > 0, "missing_safety_comment"),
        (F.size(sites) > allowed, "unsafe_over_budget"),
    )


def scope(files: Column, added: Column, branches: Column, removed_api: Column, deps: Column, allowed: Column) -> Column:
    """files, added lines, removed names, added and allowed dependencies: arrays; branches: how many by size there were."""
    sized = F.filter(
        F.transform(added, lambda x: F.trim(x)),
        lambda x: (F.startswith(x, F.lit("if ")) | F.startswith(x, F.lit("if(")) | F.contains(x, F.lit("match ")))
        & F.rlike(x, F.lit(r"len\(|size|capacity")),
    )
    return _verdict(
        (F.exists(files, lambda x: F.contains(x, F.lit("test/")) | F.contains(x, F.lit("bench"))), "touches_frozen_file"),
        (F.size(sized) > branches, "input_size_branch"),
        (F.size(removed_api) > 0, "api_changed"),
        (F.size(F.array_except(deps, allowed)) > 0, "non_allowlisted_dep"),
    )


def is_worker_safe(detail: Column) -> Column:
    """No digit is shown."""
    return ~F.rlike(detail, F.lit("[0-9]"))


def differential(campaigns: DataFrame, pairs: DataFrame, by: str, tolerance: float = 0.0) -> DataFrame:
    """by, compared, passed, reason, failed_at (index of the first pair that fails) of each campaign.

    pairs: by, index, original, ported, and the pair's rel_tol and abs_tol, NULL where it
    has none of its own. Equal texts agree; numbers agree within the tolerance: of its own
    abs_tol + rel_tol * max(|x|, |y|, 1); where no pair of the campaign has one,
    tolerance * max(|x|, 1), and beyond those that have, their rule with the common one.
    A campaign without pairs fails. Of pairs with one
    index the reason is the first by name.
    """
    own = F.max(F.when(F.col("rel_tol").isNotNull(), F.col("index"))).alias("last")
    has = pairs.groupBy(F.col(by).alias("h_by")).agg(own)
    x, y = F.col("original").try_cast("double"), F.col("ported").try_cast("double")
    least = F.greatest(F.abs(x), F.abs(y), F.lit(1.0))
    room = F.when(F.col("last").isNull(), tolerance * F.greatest(F.abs(x), F.lit(1.0))).otherwise(
        F.coalesce("abs_tol", F.lit(0.0)) + F.coalesce("rel_tol", F.lit(tolerance)) * least
    )
    numbers = x.isNotNull() & y.isNotNull() & (F.col("last").isNotNull() | F.lit(tolerance != 0.0))
    wrong = F.when(F.col("original") == F.col("ported"), None).when(~numbers, "mismatch").when(F.abs(x - y) > room, "tolerance_exceeded")
    judged = pairs.join(has, pairs[by].eqNullSafe(F.col("h_by"))).withColumn("wrong", wrong)
    first = F.min(F.when(F.col("wrong").isNotNull(), F.struct("index", "wrong")))
    found = judged.groupBy("h_by").agg(F.count(F.lit(1)).alias("n"), first.alias("first"))
    rows = campaigns.select(by).join(found, F.col(by).eqNullSafe(F.col("h_by")), "left")
    reason = F.when(F.col("n").isNull(), "empty_campaign").otherwise(F.col("first.wrong"))
    return rows.select(
        by, F.coalesce("n", F.lit(0)).alias("compared"), reason.isNull().alias("passed"), reason.alias("reason"), F.col("first.index").alias("failed_at")
    )


def parity_with_known(outcomes: DataFrame, known: DataFrame, by: str) -> DataFrame:
    """by, passed, reason, n_failed, n_extras of each run: no test fails or times out but the known ones.

    outcomes: by, name, outcome (pass, fail, timeout, skip, xfail); known: name.
    """
    bad = F.col("outcome").isin("fail", "timeout")
    marked = outcomes.join(known.select(F.col("name").alias("k_name")).distinct(), F.col("name") == F.col("k_name"), "left")
    # by name first, which needs no rows of their own for each distinct count
    named = marked.groupBy(by, "name").agg(
        F.count_if(bad | (F.col("outcome") == "pass")).alias("ran"),
        ((F.count_if(bad) > 0) & F.col("name").isNotNull()).alias("failed"),
        F.max("k_name").isNull().alias("unknown"),
    )
    per = named.groupBy(by).agg(
        F.sum("ran").alias("ran"), F.count_if("failed").alias("n_failed"), F.count_if(F.col("failed") & F.col("unknown")).alias("n_extras")
    )
    v = _verdict((F.col("ran") == 0, "empty_run"), (F.col("n_extras") > 0, "failures_beyond_known"))
    return per.select(by, v["passed"].alias("passed"), v["reason"].alias("reason"), "n_failed", "n_extras")


def rates(outcomes: DataFrame, by: str) -> DataFrame:
    """by, passed, failed (timeouts too), total and pass_rate (1 of an empty run) of each run."""
    is_ = lambda *names: F.count_if(F.col("outcome").isin(*names))
    total = F.col("passed") + F.col("failed") + F.col("other")
    per = outcomes.groupBy(by).agg(
        is_("pass").alias("passed"), is_("fail", "timeout").alias("failed"), is_("skip", "xfail").alias("other")
    )
    rate = F.when(total == 0, 1.0).otherwise(F.col("passed") / total)
    return per.select(by, "passed", "failed", total.alias("total"), rate.alias("pass_rate"))


#: Words of a test summary, each with the number before it.
SUMMARY_WORDS = ("passed", "failed", "skipped", "xfailed", "deselected")


def summary_counts(text: Column) -> Column:
    """struct of the largest number that a test run's output gives before each word of a summary; 0 where there is none."""

    def most(word: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(rf"(?<![^\s,])([0-9]+)(?:[^\S\n]+[^\s,0-9][^\s,]*)*?[^\S\n]+{word}(?![^\s,.])"), F.lit(1))
        return F.coalesce(F.array_max(F.transform(found, lambda x: x.cast("long"))), F.lit(0).cast("long"))

    return F.struct(*[most(w).alias(w) for w in SUMMARY_WORDS])


def scan_numbers(line: Column) -> Column:
    """All number literals of a line in order, as text: with sign, fraction and exponent; a sign glued to a word is none."""
    return F.regexp_extract_all(
        line, F.lit(r"(?:(?<![A-Za-z0-9])[+-](?=[0-9]))?(?:[0-9]+(?:\.[0-9]*)?|(?<![A-Za-z0-9])\.[0-9]+)(?:[eE][+-]?[0-9]+)?"), F.lit(0)
    )


#: Names that tell waiting, native and regular-expression code from plain code in a profile.
IO_VERBS = (
    "read write recv send flush sleep wait lock acquire release socket connect accept poll select unlink mkdir rmtree fileno"
).split()
NATIVE_VERBS = (
    "find index replace split partition decode encode translate charmap_decode utf_16 utf_32 utf-8 utf_7 decompress compress "
    "crc32 adler32 md5 sha blake hmac match search fullmatch unicodedata binascii _pickle _json mmap escape"
).split()
IO_MODULES = ("socket", "ssl", "selectors", "asyncio", "urllib", "http", "ftplib")
OVERHEAD_MODULES = ("abc.py", "typing.py", "inspect.py", "pkgutil.py", "codecs.py")


def classify_function(file: Column, func: Column, native: Column) -> Column:
    """Bucket of a profiled function; native: array of the package's own compiled modules, as lower-case file names."""
    holds = lambda text, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))
    f, base = F.lower(func), F.lower(F.element_at(F.split(file, "/"), -1))
    builtin = (
        F.when(holds(f, ("re.pattern", "re.match")), "regex").when(holds(f, IO_VERBS), "io_wait")
        .when(holds(f, NATIVE_VERBS), "native").otherwise("pure_python")
    )
    return (
        F.when(file == "~", builtin)
        .when(F.array_contains(native, base), "native")
        .when((base == "re.py") | F.contains(base, F.lit("sre_")), "regex")
        .when((base == "io.py") | holds(base, IO_MODULES), "io_wait")
        .when(F.startswith(base, F.lit("<frozen")) | F.contains(base, F.lit("importlib")) | base.isin(*OVERHEAD_MODULES), "overhead")
        .otherwise("pure_python")
    )


def first_filter(path: Column, filters: Column) -> Column:
    """Path of a candidate after its filters (array of dispositions): the first alone counts, and only on a mirror."""
    first = F.get(filters, F.lit(0))
    return F.when((path == "mirror") & (first == "upstream_only"), "upstream").otherwise(path)


def normal_name(name: Column) -> Column:
    """A distribution's name: runs of - _ . are one dash, none at the ends, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, "^[-_.]+|[-_.]+$", ""), "[-_.]+", "-"))


def is_version(text: Column) -> Column:
    return F.rlike(text, F.lit(r"\A[0-9]+\.[0-9]+\.[0-9]+(?:[-+](?s:.*))?\z"))


def is_repo(text: Column) -> Column:
    return F.rlike(text, F.lit(r"\A[A-Za-z0-9._-]+/[A-Za-z0-9._-]+\z"))


def requires_floor(spec: Column) -> Column:
    """(major, minor) of a lower bound such as >=3.9,<4 that comes first; NULL where there is none."""
    p = r"\A\s*>=\s*([0-9]+)\.([0-9]+)\s*(?:\.[^,]*)?(?:,|\z)"
    return F.when(F.rlike(spec, F.lit(p)), F.struct(*[F.regexp_extract(spec, p, i + 1).cast("long").alias(n) for i, n in enumerate(("major", "minor"))]))


#: Outcomes whose tests must be the baseline's own, in the order in which they are looked at, and the reasons they give.
LISTED = (("skip", "skip_mismatch"), ("xfail", "xfail_mismatch"), ("deselected", "deselect_mismatch"))


def oracle_integrity(outcomes: DataFrame, baseline: DataFrame, hashes: DataFrame, manifest: DataFrame, by: str) -> DataFrame:
    """by, passed, reason, path, test_count of each run: that it ran the tests it should, with the files it should.

    outcomes: by, test, outcome ("deselected" too); baseline: test, outcome; hashes: by,
    path, sha256; manifest: path, sha256. Reasons, the first that holds: count_mismatch
    (of tests), then tests skipped, expected to fail or deselected that are not those
    of the baseline, hash_mismatch (path is the first such file) and missing_file. Files
    beside the manifest don't matter. Only sums by run are shuffled; baseline and
    manifest are the size of one run.
    """
    kinds = [k for k, _ in LISTED]
    expected = baseline.agg(F.count_distinct("test"), *[F.count_if(F.col("outcome") == k) for k in kinds]).first()
    known = baseline.select("test", F.col("outcome").alias("b_outcome")).distinct()
    joined = outcomes.select(by, "test", "outcome").distinct().join(known, "test", "left")
    same = F.col("outcome") == F.col("b_outcome")
    ran = joined.groupBy(by).agg(
        F.count(F.lit(1)).alias("test_count"),
        *[F.count_if(F.col("outcome") == k).alias(f"got_{k}") for k in kinds],
        *[F.count_if((F.col("outcome") == k) & same).alias(f"same_{k}") for k in kinds],
    )
    n_files = manifest.select("path").distinct().count()
    files = hashes.select(by, "path", "sha256").join(manifest.select("path", F.col("sha256").alias("want")), "path")
    seen = files.groupBy(by).agg(F.count_distinct("path").alias("files"), F.min(F.when(F.col("sha256") != F.col("want"), F.col("path"))).alias("path"))
    v = _verdict(
        (F.col("test_count") != expected[0], "count_mismatch"),
        *[((F.col(f"got_{k}") != n) | (F.col(f"same_{k}") != n), reason) for (k, reason), n in zip(LISTED, expected[1:])],
        (F.col("path").isNotNull(), "hash_mismatch"),
        (F.coalesce("files", F.lit(0)) < n_files, "missing_file"),
    )
    found = ran.join(seen, by, "left").withColumn("v", v)
    return found.select(by, "v.passed", "v.reason", F.when(F.col("v.reason") == "hash_mismatch", F.col("path")).alias("path"), "test_count")

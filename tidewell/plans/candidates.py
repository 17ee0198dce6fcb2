"""Parts as candidate packages, orders as runs of a suite."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import gates, packages
from tidewell.registry import query
from tidewell.sources import archives
from tidewell.sources.tables import table

_WORDS = "[" + ", ".join(f"'{w}'" for w in archives.HOT_WORDS) + "]"
#: What is known of a part as a package; the same expressions in both dialects.
_FACTS = {
    "downloads": "CAST(p_retailprice * 1000 AS BIGINT)",
    "curated": "p_partkey % 11",
    "py_lines": "CASE WHEN p_partkey % 13 <> 0 THEN p_size * 60 END",
    "native_files": "p_partkey % 3",
    "native_build": "p_partkey % 2 = 0",
    "summary": "CASE p_partkey % 4 WHEN 0 THEN p_name || ' json token' WHEN 1 THEN p_type || ' hash' ELSE p_name END",
    "member": "CASE p_partkey % 3 WHEN 0 THEN 'pkg/tokenizer.py' WHEN 1 THEN 'pkg/date/url.py' ELSE 'pkg/x' END",
    "filtered": "p_partkey % 7",
    "probed": "p_partkey % 5",
}
_SQL = f"""WITH f AS (SELECT p_partkey, {", ".join(f"{v} AS {k}" for k, v in _FACTS.items())} FROM part),
  w AS (SELECT *, len(list_filter({_WORDS}, lambda w: contains(lower(summary), w) OR contains(member, w))) AS words FROM f),
  r AS (SELECT *, CASE WHEN curated IN (1, 2) THEN 'adopt' WHEN curated = 3 THEN 'upstream' WHEN py_lines >= 2000 AND native_files > 0 AND native_build THEN 'upstream'
          WHEN py_lines < 1000 AND words = 0 AND native_files = 0 THEN 'adopt' ELSE 'mirror' END AS rule,
        CASE WHEN curated = 1 THEN 'full' WHEN curated = 2 THEN 'noop' WHEN curated = 3 THEN 'upstream' WHEN py_lines >= 2000 AND native_files > 0 AND native_build THEN 'native_build'
          WHEN py_lines < 1000 AND words = 0 AND native_files = 0 THEN 'trivial' ELSE 'no_equivalent' END AS why FROM w),
  a AS (SELECT *, CASE WHEN rule <> 'mirror' THEN NULL WHEN filtered = 1 THEN 'upstream_only' WHEN filtered = 2 THEN 'exclude' WHEN filtered = 3 THEN 'demote'
          WHEN probed = 1 THEN 'upstream_only' WHEN probed = 2 THEN 'exclude' END AS act FROM r),
  c AS (SELECT p_partkey, CASE WHEN act = 'upstream_only' THEN 'upstream' ELSE rule END AS path,
          CASE WHEN act = 'upstream_only' THEN CASE WHEN filtered = 1 THEN 'filter' ELSE 'headroom' END ELSE why END AS reason,
          CASE WHEN rule = 'mirror' AND act IS DISTINCT FROM 'upstream_only' THEN CASE act WHEN 'exclude' THEN 'excluded' WHEN 'demote' THEN 'demoted' ELSE 'clean' END END AS section,
          CASE WHEN rule = 'mirror' AND act IS DISTINCT FROM 'upstream_only' THEN downloads / 1000000 * CASE WHEN py_lines IS NULL THEN 1 ELSE 1 + words END END AS payoff FROM a)"""


def _classified(spark, d):
    f = table(spark, d, "part").select("p_partkey", *[F.expr(v).alias(k) for k, v in _FACTS.items()])
    pick = lambda of, *values: F.coalesce(*[F.when(F.col(of) == k + 1, v) for k, v in enumerate(values)])
    no_words = F.array().cast("array<string>")
    verdict = F.coalesce(pick("curated", *[F.array(F.lit("partial"), F.lit(v)) for v in ("full", "noop", "upstream")]), no_words)
    filters = F.coalesce(pick("filtered", *[F.array(F.lit(v), F.lit("exclude")) for v in ("upstream_only", "exclude", "demote")]), no_words)
    rows = f.select(
        "p_partkey", "downloads", verdict.alias("verdicts"), "py_lines", "native_files", "native_build", archives._words_in(F.col("member")).alias("words"),
        archives._words_in(F.lower("summary")).alias("summary_words"), filters.alias("filters"), pick("probed", F.lit("upstream_only"), F.lit("exclude"), F.lit("demote")).alias("headroom"),
    )
    return packages.classify(rows, "p_partkey")


@query("prj_payoff", f"{_SQL} SELECT p_partkey, path, reason, section, round(payoff, 6) AS payoff FROM c")
def prj_payoff(spark, d):
    return _classified(spark, d).withColumn("payoff", F.round("payoff", 6))


@query(
    "win_payrank",
    f"""{_SQL} SELECT p_partkey, section, CASE WHEN section IN ('clean', 'demoted') THEN CAST(row_number() OVER (PARTITION BY section ORDER BY payoff DESC, p_partkey) AS INTEGER) END AS rank FROM c""",
)
def win_payrank(spark, d):
    return packages.ranked(_classified(spark, d), "p_partkey").select("p_partkey", "section", "rank")




@query(
    "prj_oracle_integrity",
    """SELECT o_orderkey, coalesce(reason, 'ok') = 'ok' AS passed, reason, CASE WHEN reason = 'hash_mismatch' THEN 'ASIA.f' END AS path, CAST(CASE WHEN o_orderkey % 7 = 0 THEN 4 ELSE 5 END AS BIGINT) AS test_count
       FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'count_mismatch' WHEN o_orderkey % 11 = 0 THEN 'skip_mismatch' WHEN o_orderkey % 13 = 0 THEN 'xfail_mismatch'
         WHEN o_orderkey % 17 = 0 THEN 'deselect_mismatch' WHEN o_orderkey % 19 = 0 THEN 'hash_mismatch' WHEN o_orderkey % 23 = 0 THEN 'missing_file' END AS reason FROM orders)""",
)
def prj_oracle_integrity(spark, d):
    """Each order runs a test a region: one to be skipped, one to fail, one deselected; a file a region."""
    regions = table(spark, d, "region").select(F.col("r_regionkey").alias("t"), F.concat("r_name", F.lit(".f")).alias("path"))
    kind = F.element_at(F.array(*map(F.lit, ("skip", "xfail", "deselected", "pass", "fail"))), F.col("t") + 1)
    baseline = regions.select(F.col("t").alias("test"), kind.alias("outcome"))
    manifest = regions.select("path", F.sha2("path", 256).alias("sha256"))
    key = F.col("o_orderkey")
    runs = table(spark, d, "orders").select("o_orderkey").join(F.broadcast(regions))  # five regions
    swap = F.when((key % 11 == 0) & (F.col("t") < 2), 1 - F.col("t")).when((key % 13 == 0) & F.col("t").isin(1, 3), 4 - F.col("t")).when((key % 17 == 0) & F.col("t").isin(2, 4), 6 - F.col("t")).otherwise(F.col("t"))
    outcomes = runs.filter((key % 7 != 0) | (F.col("t") > 0)).select("o_orderkey", swap.alias("test"), kind.alias("outcome"))
    bad = (key % 19 == 0) & F.col("path").isin("ASIA.f", "EUROPE.f")
    hashes = runs.filter((key % 23 != 0) | (F.col("t") != 3)).select("o_orderkey", "path", F.when(bad, "changed").otherwise(F.sha2("path", 256)).alias("sha256"))
    return gates.oracle_integrity(outcomes, baseline, hashes, manifest, "o_orderkey")

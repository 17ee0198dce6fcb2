"""The ledger: a folder of Parquet tables, read whatever version wrote them, and appended to by checked rows.

A table is a folder of its name. A reader brings it to its schema: columns that came
later than a table get their default, further ones go, and a table that is not there
is empty. Writers reject rows that break a table's rules, with the reason, into a
folder beside it; the rest is appended. Measurements stay NULL where nothing was measured.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.sources.session import materialize
from tidewell.sources.tables import align_schema

# The tables' columns, what stands where a column is missing or NULL, the columns that may not be
# NULL, and those that may not be empty either.
SCHEMAS = {
    "runs": "id string, repo_url string, source_lang string, status string, stage string, started_at long, ended_at long, halt_reason string",
    "units": "id string, run_id string, kind string, spec_json string, depends_on string, status string, attempts long, worktree string, commit_sha string, tokens_in long, tokens_out long",
    "gate_results": "id long, unit_id string, gate string, passed int, detail_json string, ran_at long",
    "decisions": "id long, run_id string, question string, seat_positions_json string, resolution string, resolved_by string, decided_at long",
    "optimizations": "id long, run_id string, round long, hotspot string, commit_sha string, delta_pct double, technique string, harvest_class string, files_touched_json string, "
    "bound string, tier long, ceiling_pct double, visible_gain_pct double, heldout_gain_pct double, divergence_pct double, instrument string, ci_low double, ci_high double, "
    "attribution_verified int, rss_delta_pct double, alloc_delta_pct double, model string, prompt_version string, guidance_version string, proposal_text string, tokens_spent long, parent_sha string, patch_text string",
    "failed_optimizations": "id long, run_id string, round long, hotspot string, bound string, tier long, technique string, outcome string, gate string, measured_delta_pct double, detail_json string, "
    "tokens_spent long, model string, prompt_version string, guidance_version string, proposal_text string, parent_sha string, patch_text string",
    "rounds": "id long, run_id string, round long, stop_reason string, gain_low double, gain_high double, created_at long",
    "guidance_revisions": "id long, created_at long, guidance_version string, change_summary string, evidence_query string, stats_json string, runs_included_json string, decided_by string, prompt_diff string",
    "github_repos": "run_id string, repo string, remote string, visibility string, license string, sha string, created_at long",
    "hunks": "id long, run_id string, unit_id string, package string, source string, before_ref string, after_ref string, wall_delta_pct double, workload string, verdict string, recorded_at long",
}
DEFAULTS = {
    "units": {"depends_on": "[]", "attempts": 0, "tokens_in": 0, "tokens_out": 0},
    "optimizations": {
        "harvest_class": "", "bound": "", "tier": 0, "ceiling_pct": 0.0, "visible_gain_pct": 0.0, "heldout_gain_pct": 0.0, "divergence_pct": 0.0, "instrument": "",
        "attribution_verified": 0, "rss_delta_pct": 0.0, "alloc_delta_pct": 0.0, "model": "", "prompt_version": "", "guidance_version": "", "proposal_text": "", "tokens_spent": 0,
        "parent_sha": "", "patch_text": "",
    },
    "failed_optimizations": {"patch_text": ""},
}
NULLABLE = {
    "runs": ("ended_at", "halt_reason"), "units": ("depends_on", "attempts", "worktree", "commit_sha", "tokens_in", "tokens_out"), "optimizations": ("harvest_class", "ci_low", "ci_high"),
    "failed_optimizations": ("gate", "measured_delta_pct"), "rounds": ("gain_low", "gain_high"), "hunks": ("wall_delta_pct", "workload"),
}
FILLED = {"hunks": ("run_id", "unit_id", "package", "source", "before_ref", "after_ref", "verdict")}
#: What orders a table's rows in a run, and which column names the run.
ORDER = {"runs": ("id",), "units": ("id",), "optimizations": ("round", "id"), "failed_optimizations": ("round", "id"), "rounds": ("round",), "decisions": ("id",), "hunks": ("id",)}
#: The one outcome that has no patch.
NO_PATCH = "rejected_at_proposal"


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the ledger in its schema; defaults stand for missing columns and for NULL where it has one."""
    try:
        found = spark.read.option("mergeSchema", "true").parquet(f"{path.rstrip('/')}/{name}")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema(name))
    defaults = DEFAULTS.get(name, {})
    rows = align_schema(found, schema(name), defaults)
    return rows.fillna(defaults) if defaults else rows


def of_run(table: DataFrame, name: str, run: str) -> DataFrame:
    """A run's rows in the table's order."""
    column = "id" if name == "runs" else "run_id"
    return table.filter(F.col(column) == run).orderBy(*ORDER.get(name, ()))


def halt_reasons(runs: DataFrame) -> DataFrame:
    """id, halt_reason of the runs that were halted."""
    return runs.filter("halt_reason IS NOT NULL").select("id", "halt_reason")


def broken_rule(name: str) -> Column:
    """Why a row cannot be stored: the first column, in the schema's order, that is NULL or empty and must not be; NULL if none."""
    rules = []
    for f in schema(name).fields:
        if f.name in FILLED.get(name, ()):
            rules.append(F.when(F.coalesce(F.col(f.name), F.lit("")) == "", F.lit(f"{f.name} must be non-empty")))
        elif f.name != "id" and f.name not in NULLABLE.get(name, ()):
            rules.append(F.when(F.col(f.name).isNull(), F.lit(f"{f.name} must not be NULL")))
    if name == "failed_optimizations":
        rules.append(F.when((F.col("patch_text") == "") & (F.col("outcome") != NO_PATCH), F.lit("patch_text must be non-empty")))
    return F.coalesce(*rules)


def append_rows(rows: DataFrame, path: str, name: str) -> tuple[int, int]:
    """Appends rows to a table of the ledger, and those that break its rules, with a reason, to its folder of rejects.

    Returns how many went to each. Missing columns get their defaults; measurements
    that are NULL stay NULL. The rows are written once, so that both parts are of the
    same rows.
    """
    known = align_schema(rows, schema(name), DEFAULTS.get(name, {}))
    checked = materialize(known.withColumn("reason", broken_rule(name)), name)
    good, bad = checked.filter("reason IS NULL").drop("reason"), checked.filter("reason IS NOT NULL")
    good.write.mode("append").parquet(f"{path.rstrip('/')}/{name}")
    bad.write.mode("append").parquet(f"{path.rstrip('/')}/{name}_rejected")
    counts = checked.agg(F.count_if(F.col("reason").isNull()), F.count("reason")).first()
    return counts[0], counts[1]


def read_rejects(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/{name}_rejected")

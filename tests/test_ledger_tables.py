"""Ledger tables: old versions, missing tables, order, rejected rows."""

import pytest
from pyspark.sql import functions as F

from tidewell.sources import ledger


def test_every_schema_reads_as_empty_and_keeps_its_columns(spark, tmp_path):
    for name in ledger.SCHEMAS:
        t = ledger.read_table(spark, str(tmp_path), name)
        assert t.schema == ledger.schema(name) and t.count() == 0
        assert set(ledger.DEFAULTS.get(name, {})) | set(ledger.NULLABLE.get(name, ())) | set(ledger.FILLED.get(name, ())) <= set(t.columns)


def test_old_and_new_files_of_one_table(spark, tmp_path):
    old = spark.createDataFrame([(2, "r", 1), (1, "r", 1), (3, "r", 0), (4, "q", 0)], "id long, run_id string, round long")
    new = spark.createDataFrame([(5, "r", 2, "diff", None)], "id long, run_id string, round long, patch_text string, harvest_class string")
    for part in (old, new):
        part.write.mode("append").parquet(f"{tmp_path}/optimizations")
    t = ledger.read_table(spark, str(tmp_path), "optimizations")
    got = [(r.id, r.patch_text, r.harvest_class, r.ci_low, r.tokens_spent) for r in ledger.of_run(t, "optimizations", "r").collect()]
    assert got == [(3, "", "", None, 0), (1, "", "", None, 0), (2, "", "", None, 0), (5, "diff", "", None, 0)]


def test_rejected_rows_keep_their_reason(spark, tmp_path):
    path = str(tmp_path)
    rows = [("r", "u", "p", "s", "b", "a", None, None, "ok"), ("", "u", "p", "s", "b", "a", 1.0, "w", "ok"), ("r", "u", "p", "s", "b", None, 1.0, "w", "")]
    hunks = spark.createDataFrame(rows, "run_id string, unit_id string, package string, source string, before_ref string, after_ref string, wall_delta_pct double, workload string, verdict string")
    assert ledger.append_rows(hunks.withColumn("recorded_at", F.lit(5)), path, "hunks") == (1, 2)
    assert ledger.append_rows(hunks, path, "hunks") == (0, 3)  # nothing says when
    stored = ledger.read_table(spark, path, "hunks").collect()
    assert len(stored) == 1 and stored[0].wall_delta_pct is None and stored[0].workload is None
    reasons = sorted(r.reason for r in ledger.read_rejects(spark, path, "hunks").collect())
    assert reasons == ["after_ref must be non-empty"] * 2 + ["recorded_at must not be NULL"] + ["run_id must be non-empty"] * 2


@pytest.mark.parametrize("outcome, patch, ok", [("rejected_at_proposal", "", 1), ("no_gain", "", 0), ("no_gain", "diff", 1)])
def test_a_failure_has_a_patch_unless_nothing_was_written(spark, tmp_path, outcome, patch, ok):
    row = spark.range(1).select(F.lit("r").alias("run_id"), F.lit(1).alias("round"), *[F.lit("x").alias(c) for c in ("hotspot", "bound", "technique", "detail_json", "model", "prompt_version", "guidance_version", "proposal_text", "parent_sha")],
        F.lit(1).alias("tier"), F.lit(9).alias("tokens_spent"), F.lit(outcome).alias("outcome"), F.lit(patch).alias("patch_text"))
    assert ledger.append_rows(row, str(tmp_path), "failed_optimizations") == (ok, 1 - ok)


def test_halted_runs(spark):
    runs = spark.createDataFrame([("a", "stop"), ("b", None)], "id string, halt_reason string")
    assert [tuple(r) for r in ledger.halt_reasons(runs).collect()] == [("a", "stop")]

"""Scrubbing in linear time, and cuts by bytes."""

import time

import pytest
from pyspark.sql import functions as F

from tidewell.functions import scrub


@pytest.mark.parametrize("unit", [" ", "-", ".", "7", "a", "@", "x ", "1 ", "- 1", "/", "=", "\n", "é"], ids=repr)
def test_long_runs_take_linear_time(spark, unit):
    """A megabyte of anything takes no more than some seconds, whatever the rule."""
    rows = spark.createDataFrame([(unit * (1_000_000 // len(unit)),)], "text string").repartition(1)
    began = time.monotonic()
    rows.select(F.char_length(scrub.scrub_text(F.col("text")))).first()
    assert time.monotonic() - began < 12


def test_phones_after_long_runs(spark):
    rows = [("call" + " " * 5000 + "+1 (555) 013-4455" + "-" * 5000 + " x",), ("(" * 50 + "555) 013-4455",), ("2026-10-26 555-013-4455",)]
    got = [r[0] for r in spark.createDataFrame(rows, "text string").select(scrub.scrub_text(F.col("text"), rules=("phone",))).collect()]
    assert got[0] == "call" + " " * 5000 + scrub.PII + "-" * 5000 + " x" and got[1] == scrub.PII


@pytest.mark.parametrize("tail", ["x", "é", "日", "😀"])
def test_first_bytes(spark, tail):
    texts = [(tail * 300,), ("a" + tail * 300,), ("ab" + tail * 300,), ("abc" + tail * 300,), (tail * 3,), ("",), (None,)]
    for t, got in spark.createDataFrame(texts, "t string").select("t", scrub.first_bytes(F.col("t"), 240).alias("x")).collect():
        assert got == (None if t is None else t.encode()[:240].decode(errors="ignore"))

"""An append-only event log, and a reader with a bookmark that gives each run once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.sources.tables import EVENTS


def append_events(events: DataFrame, path: str) -> None:
    """Appends events (ts, run_id, kind, detail) to a log, a JSON object a line; earlier files are never touched."""
    rows = events.select(F.to_json(F.struct("ts", "run_id", "kind", "detail"), {"ignoreNullFields": "false"}).alias("value"))
    rows.write.mode("append").text(path)


def export_new_runs(spark: SparkSession, log: str, out: str, bookmark: str, done: str = "run_end") -> int:
    """Appends run_id, ended_at of each run that ended since the last call to the Parquet folder out, and returns how many.

    The stream reads the log's files that came since, and stops. Its bookmark holds the
    files that are done and the runs that were given, so that a run that ends twice, or a
    call that broke off and is repeated, gives no run again. A batch is written under
    its own number: one that is repeated after a failure replaces what it wrote. Lines that
    are not events are passed over.
    """
    lines = spark.readStream.text(log)
    parsed = lines.select(F.from_json("value", EVENTS, {"mode": "PERMISSIVE"}).alias("e")).select("e.*")
    ended = parsed.filter((F.col("kind") == done) & F.col("ts").isNotNull() & F.col("run_id").isNotNull())
    fresh = ended.select("run_id", F.col("ts").alias("ended_at")).dropDuplicates(["run_id"])
    found = []

    def write(batch: DataFrame, number: int) -> None:
        target = f"{out.rstrip('/')}/batch={number}"
        batch.write.mode("overwrite").parquet(target)
        found.append(spark.read.parquet(target).count())

    query = (
        fresh.writeStream.option("checkpointLocation", bookmark)
        .queryName(f"runs-{uuid.uuid4().hex[:8]}")
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
    return sum(found)


def exported_runs(spark: SparkSession, out: str) -> DataFrame:
    """run_id, ended_at, batch of all calls so far."""
    return spark.read.parquet(out)

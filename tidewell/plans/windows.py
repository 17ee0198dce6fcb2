"""Windows over the event stream: an extension, as the ledger's log is append-only."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.registry import query
from tidewell.sources.tables import table
from tidewell.streaming.events import session_totals, window_totals


@query(
    "ext_tumbling",
    "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS at, event_type, count(*) AS n FROM events GROUP BY 1, 2",
)
def ext_tumbling(spark, d):
    return window_totals(table(spark, d, "events"), "6 hours").select("at", "event_type", "n")


@query(
    "ext_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
       s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
       SELECT user_id, min(ts) AS at, count(*) AS n FROM s GROUP BY user_id, k""",
)
def ext_sessions(spark, d):
    return session_totals(table(spark, d, "events"), "2 hours").select("user_id", "at", "n")


@query("st_incremental", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-25 00:00:00'")
def st_incremental(spark, d):
    return table(spark, d, "events").filter(F.col("ts") > F.lit("2024-01-25").cast("timestamp_ntz")).select("event_id")

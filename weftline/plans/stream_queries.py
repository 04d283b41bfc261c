"""Streaming queries on the event table, drained to tables, with the SQL of their batch results."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.streaming import tables


def stream_event_windows(spark, directory):
    events = tables.stream_table(spark, directory, "events").withColumn("value", F.floor(F.col("value") * 1000 + 0.5).cast("long"))
    return tables.drained(tables.event_windows(events, "ts", ["event_type"], "value")).withColumn("window_start", F.unix_micros("window_start"))


def stream_sessions(spark, directory):
    s = tables.drained(tables.sessions(tables.stream_table(spark, directory, "events"), "ts", ["user_id"]))
    return s.withColumns({"session_start": F.unix_micros("session_start"), "session_end": F.unix_micros("session_end")})


QUERIES = {f.__name__: f for f in (stream_event_windows, stream_sessions)}

ORACLE = {
    "stream_event_windows": "SELECT event_type, epoch_us(date_trunc('hour', ts)) AS window_start, count(*) AS n, sum(floor(value * 1000 + 0.5)::BIGINT)::BIGINT AS total FROM events GROUP BY ALL",
    "stream_sessions": """
SELECT user_id, min(t) AS session_start, max(t) + 1800000000 AS session_end, count(*) AS n FROM (
  SELECT *, sum(CASE WHEN t - b <= 1800000000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS g FROM (
    SELECT user_id, event_id, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)) GROUP BY user_id, g""",
}

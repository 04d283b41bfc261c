"""Queries of the general operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.operators import periods
from weftline.plans import cut_sql, export_queries, interval_queries, job_queries, more_queries, stream_queries, word_queries
from weftline.runtime import table


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    return periods.speech_gaps(table(spark, directory, "speakers"), table(spark, directory, "segments"))


def p5_periods(spark: SparkSession, directory: str) -> DataFrame:
    return periods.speech_periods(table(spark, directory, "speakers"), table(spark, directory, "segments"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p5_found, p5_periods)} | interval_queries.QUERIES | word_queries.QUERIES | export_queries.QUERIES | stream_queries.QUERIES | more_queries.QUERIES | job_queries.QUERIES

_P5 = """
WITH raw AS (
  SELECT video_id, speaker, 'turns' AS src, x."start" AS a, x."end" AS b FROM (SELECT video_id, speaker, unnest(turns) AS x FROM speakers)
  UNION ALL SELECT video_id, speaker, 'exclusive_turns', x."start", x."end" FROM (SELECT video_id, speaker, unnest(exclusive_turns) AS x FROM speakers)
  UNION ALL SELECT video_id, speaker, 'segments', "start", "end" FROM segments),
iv AS (
  SELECT DISTINCT video_id, speaker, src, floor(a * 1000 + 0.5)::BIGINT AS s, floor(b * 1000 + 0.5)::BIGINT AS e FROM raw
  WHERE trim(speaker) <> '' AND a IS NOT NULL AND b IS NOT NULL AND floor(b * 1000 + 0.5) > floor(a * 1000 + 0.5)),
reach AS (
  SELECT *, max(e) OVER (PARTITION BY video_id, speaker, src ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM iv),
period AS (
  SELECT video_id, speaker, src, min(s) AS s, max(e) AS e FROM (
    SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, speaker, src ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM reach)
  GROUP BY video_id, speaker, src, g)
"""

ORACLE: dict[str, str] = {
    "p5_found": _P5
    + """SELECT video_id, speaker, src, gap_start_ms, gap_end_ms FROM (
  SELECT video_id, speaker, src, e AS gap_start_ms, lead(s) OVER (PARTITION BY video_id, speaker, src ORDER BY s) AS gap_end_ms FROM period)
WHERE gap_end_ms IS NOT NULL""",
    "p5_periods": _P5 + "SELECT video_id, speaker, src, s AS start_ms, e AS end_ms FROM period",
} | interval_queries.ORACLE | word_queries.ORACLE | export_queries.ORACLE | stream_queries.ORACLE | more_queries.ORACLE | job_queries.ORACLE | {"word_cut_segments": cut_sql.WORD_CUT}

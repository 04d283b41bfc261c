"""Queries of the interval operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import intervals, periods, rows
from weftline.plans.views import clips, merged, query, spans, turns

KEYS = ["video_id", "speaker"]


def interval_merge(spark, directory):
    return intervals.merge_close(turns(spark, directory), KEYS, 2000)


def speaker_totals(spark, directory):
    t = turns(spark, directory)
    sums = t.groupBy(*KEYS).agg(F.sum(F.col("e") - F.col("s")).alias("total_ms"), F.count("*").alias("n_turns"))
    real = periods.periods(t, KEYS).groupBy(*KEYS).agg(F.sum(F.col("e") - F.col("s")).alias("covered_ms"))
    return sums.join(real, KEYS)


def interval_overlap_join(spark, directory):
    t = turns(spark, directory)
    return intervals.meeting_others(t, t, 400).select(*KEYS, F.greatest("s", "rs").alias("s"), F.least("e", "re").alias("e")).where("e - s >= 50")


def interval_semi(spark, directory):
    cut = spans(spark, directory).select(*KEYS, F.col("s").alias("rs"), F.col("e").alias("re"))
    return intervals.touching(turns(spark, directory), cut, KEYS)


def interval_overlap_seconds(spark, directory):
    return intervals.others_ms(spans(spark, directory), turns(spark, directory)).select("seg_id", "overlap_ms")


def interval_subtract(spark, directory):
    t = turns(spark, directory)
    return intervals.subtract_others(t, t, 150)


def crosstalk_removal(spark, directory):
    return intervals.crosstalk_free(turns(spark, directory, "exclusive_turns"), turns(spark, directory))


def overlap_sweep(spark, directory):
    return intervals.overlap_sweep(turns(spark, directory), ["video_id"])


def overlap_metric(spark, directory):
    r = intervals.overlap_sweep(turns(spark, directory), ["video_id"])
    m = r.groupBy("video_id").agg(F.sum(F.col("e") - F.col("s")).alias("total_ms"), F.max(F.col("e") - F.col("s")).alias("worst_ms"))
    return m.withColumn("worth", (F.col("total_ms") >= 8000) | (F.col("worst_ms") >= 1500))


def window_tiling(spark, directory):
    r = intervals.overlap_sweep(turns(spark, directory), ["video_id"])
    return intervals.tiles(r, ["video_id"]).groupBy("video_id").agg(F.count("*").alias("n_windows"), F.min("window").alias("first_window"))


def suspect_regions(spark, directory):
    t = turns(spark, directory)
    return intervals.suspects(t, intervals.overlap_sweep(t, ["video_id"]))


def chunk_plan(spark, directory):
    return intervals.chunk_plan(turns(spark, directory), KEYS)


def asof_prev_next(spark, directory):
    points = spans(spark, directory).select(*KEYS, F.col("s").alias("t"))
    return intervals.as_of(points, turns(spark, directory), KEYS)


def no_cut_zones(spark, directory):
    from weftline.plans.views import candidates

    c = candidates(spark, directory).where("position_ms IS NOT NULL").select("seg_id", "position_ms")
    at = clips(spark, directory).where("s IS NOT NULL AND video_id IS NOT NULL").select("seg_id", "video_id", "s")
    zones = c.join(at, "seg_id").select("video_id", (F.col("s") + F.col("position_ms")).alias("s")).withColumn("e", F.col("s"))
    return intervals.merge_close(intervals.dilate(zones, 500), ["video_id"])


def point_in_interval(spark, directory):
    """Which clip of its own speaker each turn begins in; the first of several."""
    points = turns(spark, directory).select(*KEYS, "s", (F.col("s") + 1).alias("e")).distinct()
    cut = spans(spark, directory).select(*KEYS, F.col("s").alias("rs"), F.col("e").alias("re"), "seg_id")
    hit = intervals.overlap_join(points, cut, KEYS)
    return hit.groupBy(*KEYS, F.col("s").alias("t")).agg(F.min(F.struct("rs", "seg_id")).alias("m")).select(*KEYS, "t", "m.seg_id")


def audition_window(spark, directory):
    """Clips of the recording within 2 s of each clip's start, by their number."""
    cut = spans(spark, directory)
    around = cut.select("seg_id", "video_id", (F.col("s") - 2000).alias("s"), (F.col("s") + 2000).alias("e"))
    near = cut.select("video_id", F.col("s").alias("rs"), F.col("e").alias("re"))
    return intervals.overlap_join(around, near, ["video_id"]).groupBy("seg_id").agg(F.count("*").alias("n_near"))


def solo_turns(spark, directory):
    from weftline.operators.signals import longest_first

    t = turns(spark, directory)
    return longest_first(intervals.subtract_others(t, t), KEYS)


def systematic_sample(spark, directory):
    return rows.systematic_sample(spans(spark, directory), ["video_id"], ["s", "e", "seg_id"], 12, 3_600_000).select("video_id", "seg_id")


QUERIES = {f.__name__: f for f in (interval_merge, speaker_totals, interval_overlap_join, interval_semi, interval_overlap_seconds, interval_subtract, crosstalk_removal, overlap_sweep, overlap_metric, window_tiling, suspect_regions, chunk_plan, asof_prev_next, no_cut_zones, point_in_interval, audition_window, solo_turns, systematic_sample)}


def _them(name: str, pad: int) -> str:
    return f"{name} AS (SELECT w.video_id, w.speaker, t.s - {pad} AS s, t.e + {pad} AS e FROM (SELECT DISTINCT video_id, speaker FROM turns) w JOIN turns t ON t.video_id = w.video_id AND t.speaker <> w.speaker)"


def _minus(name: str, keep: str, remove: str) -> list[str]:
    """``keep`` without the (merged) intervals of ``remove``."""
    return [
        merged(f"{name}_cut", remove),
        f"""{name}_hit AS (SELECT DISTINCT k.video_id, k.speaker, k.s, k.e, r.s AS rs, r.e AS re FROM {keep} k LEFT JOIN {name}_cut r
             ON r.video_id = k.video_id AND r.speaker = k.speaker AND k.s < r.e AND r.s < k.e)""",
        f"""{name} AS (SELECT video_id, speaker, ps AS s, pe AS e FROM (
             SELECT video_id, speaker, coalesce(lag(re) OVER (PARTITION BY video_id, speaker, s, e ORDER BY rs), s) AS ps, coalesce(rs, e) AS pe FROM {name}_hit
             UNION ALL SELECT video_id, speaker, max(re), e FROM {name}_hit WHERE rs IS NOT NULL GROUP BY video_id, speaker, s, e) WHERE pe > ps)""",
    ]


_SWEEP = """sweep AS (
  SELECT video_id, s, e FROM (
    SELECT video_id, t AS s, up, lead(t) OVER (PARTITION BY video_id ORDER BY n) AS e FROM (
      SELECT *, (depth >= 2 AND depth - d < 2) AS up, (depth < 2 AND depth - d >= 2) AS down FROM (
        SELECT *, sum(d) OVER (PARTITION BY video_id ORDER BY n) AS depth FROM (
          SELECT video_id, t, d, row_number() OVER (PARTITION BY video_id ORDER BY t, d) AS n
          FROM (SELECT video_id, s AS t, 1 AS d FROM turns UNION ALL SELECT video_id, e, -1 FROM turns)))) WHERE up OR down)
  WHERE up AND e - s >= 300)"""
_SUSPECT = """raw_suspects AS (
  SELECT video_id, speaker, s, e FROM (SELECT t.video_id, t.speaker, greatest(t.s, o.s) AS s, least(t.e, o.e) AS e FROM turns t JOIN them o ON o.video_id = t.video_id AND o.speaker = t.speaker) WHERE e - s >= 50
  UNION ALL SELECT DISTINCT t.video_id, t.speaker, w.s, w.e FROM turns t JOIN sweep w ON w.video_id = t.video_id AND t.s < w.e AND w.s < t.e)"""

ORACLE = {
    "interval_merge": query("SELECT * FROM m", merged("m", "turns", 2000)),
    "speaker_totals": query(
        """SELECT a.video_id, a.speaker, a.total_ms, a.n_turns, b.covered_ms FROM (SELECT video_id, speaker, sum(e - s)::BIGINT AS total_ms, count(*) AS n_turns FROM turns GROUP BY ALL) a
           JOIN (SELECT video_id, speaker, sum(e - s)::BIGINT AS covered_ms FROM m GROUP BY ALL) b ON a.video_id = b.video_id AND a.speaker = b.speaker""",
        merged("m", "turns"),
    ),
    "interval_overlap_join": query("SELECT * FROM (SELECT t.video_id, t.speaker, greatest(t.s, o.s) AS s, least(t.e, o.e) AS e FROM turns t JOIN them o ON o.video_id = t.video_id AND o.speaker = t.speaker) WHERE e - s >= 50", _them("them", 400)),
    "interval_semi": query("SELECT * FROM turns t WHERE EXISTS (SELECT 1 FROM spans c WHERE c.video_id = t.video_id AND c.speaker = t.speaker AND t.s < c.e AND c.s < t.e)"),
    "interval_overlap_seconds": query(
        "SELECT c.seg_id, coalesce(sum(CASE WHEN o.s IS NOT NULL THEN least(c.e, o.e) - greatest(c.s, o.s) END), 0)::BIGINT AS overlap_ms FROM spans c LEFT JOIN them o ON o.video_id = c.video_id AND o.speaker = c.speaker AND c.s < o.e AND o.s < c.e GROUP BY c.seg_id", _them("them", 0)
    ),
    "interval_subtract": query("SELECT * FROM d", _them("them", 150), *_minus("d", "turns", "them")),
    "crosstalk_removal": query("SELECT * FROM m", _them("them", 150), *_minus("d", "exclusive", "them"), merged("m", "d", 300)),
    "overlap_sweep": query("SELECT * FROM sweep", _SWEEP),
    "overlap_metric": query("SELECT *, total_ms >= 8000 OR worst_ms >= 1500 AS worth FROM (SELECT video_id, sum(e - s)::BIGINT AS total_ms, max(e - s) AS worst_ms FROM sweep GROUP BY video_id)", _SWEEP),
    "window_tiling": query("SELECT video_id, count(DISTINCT k) AS n_windows, min(k) AS first_window FROM (SELECT video_id, unnest(range(s // 10000, greatest(s // 10000, (e - 1) // 10000) + 1)) AS k FROM sweep) GROUP BY video_id", _SWEEP),
    "suspect_regions": query("SELECT * FROM m", _them("them", 400), _SWEEP, _SUSPECT, merged("m", "raw_suspects", 200)),
    "chunk_plan": query(
        "SELECT video_id, speaker, k, min(s) AS s, max(e) AS e FROM fold GROUP BY video_id, speaker, k",
        merged("m", "turns", 1000),
        "block AS (SELECT *, row_number() OVER (PARTITION BY video_id, speaker ORDER BY s) AS n FROM m)",
        """fold AS (
  SELECT video_id, speaker, n, s, e, s AS cs, 0::INTEGER AS k FROM block WHERE n = 1
  UNION ALL
  SELECT b.video_id, b.speaker, b.n, b.s, b.e,
         CASE WHEN b.e - f.cs > 60000 OR (b.s - f.e >= 4000 AND f.e - f.cs >= 20000) THEN b.s ELSE f.cs END,
         CASE WHEN b.e - f.cs > 60000 OR (b.s - f.e >= 4000 AND f.e - f.cs >= 20000) THEN f.k + 1 ELSE f.k END
  FROM fold f JOIN block b ON b.video_id = f.video_id AND b.speaker = f.speaker AND b.n = f.n + 1)""",
        recursive=True,
    ),
    "asof_prev_next": query(
        """SELECT p.video_id, p.speaker, p.t, (SELECT max(e) FROM turns w WHERE w.video_id = p.video_id AND w.speaker = p.speaker AND w.e < p.t) AS prev_end,
           (SELECT min(s) FROM turns w WHERE w.video_id = p.video_id AND w.speaker = p.speaker AND w.s > p.t) AS next_start FROM (SELECT DISTINCT video_id, speaker, s AS t FROM spans) p"""
    ),
    "no_cut_zones": query("SELECT * FROM m", "zone AS (SELECT k.video_id, k.s + c.position_ms - 500 AS s, k.s + c.position_ms + 500 AS e FROM cands c JOIN clips k ON k.seg_id = c.seg_id WHERE c.position_ms IS NOT NULL AND k.s IS NOT NULL AND k.video_id IS NOT NULL)", merged("m", "zone", 0, "video_id")),
    "point_in_interval": query(
        "SELECT video_id, speaker, t, seg_id FROM (SELECT p.video_id, p.speaker, p.t, c.seg_id, row_number() OVER (PARTITION BY p.video_id, p.speaker, p.t ORDER BY c.s, c.seg_id) AS r FROM (SELECT DISTINCT video_id, speaker, s AS t FROM turns) p JOIN spans c ON c.video_id = p.video_id AND c.speaker = p.speaker AND c.s < p.t + 1 AND p.t < c.e) WHERE r = 1"
    ),
    "audition_window": query("SELECT a.seg_id, count(*) AS n_near FROM spans a JOIN spans b ON b.video_id = a.video_id AND a.s - 2000 < b.e AND b.s < a.s + 2000 GROUP BY a.seg_id"),
    "solo_turns": query(
        """SELECT video_id, speaker, s, e FROM (SELECT *, row_number() OVER (PARTITION BY video_id, speaker ORDER BY s, e) AS r FROM d WHERE e - s >= 1000) WHERE r <= 8
           UNION ALL SELECT video_id, speaker, s, e FROM (SELECT *, row_number() OVER (PARTITION BY video_id, speaker ORDER BY e - s DESC, s) AS r FROM d
             WHERE (video_id, speaker) NOT IN (SELECT (video_id, speaker) FROM d WHERE e - s >= 1000)) WHERE r <= 4""",
        _them("them", 0), *_minus("d", "turns", "them"),
    ),
    "systematic_sample": query(
        """SELECT video_id, seg_id FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY s, e, seg_id) - 1 AS k, count(*) OVER (PARTITION BY video_id) AS n FROM spans)
           WHERE n <= 12 OR k IN (SELECT unnest(list_transform(range(12), lambda i: (i * n) // 12)))"""
    ),
}

"""Continuous periods and gaps of many overlapping intervals per entity.

Starts and ends are ranked independently of each other.  After the k-th end there
is a gap exactly if the (k+1)-th start lies beyond it, which shows in the ranks
alone; the boundaries beside the gaps pair up to periods.  Ranks are counted in
bounded chunks of time, so that one entity may hold any share of the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a chunk of time in ms.  Boundaries are counted per ms first, so a chunk of an entity has no more rows than this.
CHUNK_MS = 60_000


def to_ms(seconds: Column) -> Column:
    """Seconds in ms: floor(x * 1000 + 0.5); null for null, NaN, infinite and absurdly large values."""
    ms = F.floor(seconds * 1000 + 0.5)
    return F.when(~F.isnan(seconds) & (F.abs(seconds) < 9.0e15), ms).cast("long")


def valid_intervals(rows: DataFrame, keys: list[str], start: Column, end: Column) -> DataFrame:
    """(keys..., s, e) in ms without intervals that miss a bound or whose end isn't after their start."""
    return rows.select(*keys, to_ms(start).alias("s"), to_ms(end).alias("e")).where("s IS NOT NULL AND e IS NOT NULL AND e > s")


def ranks(intervals: DataFrame, keys: list[str], chunk: int = CHUNK_MS) -> DataFrame:
    """Every distinct boundary t of an entity with its ranks in the sorted starts and in the sorted ends.

    (keys..., t, starts, ends, opens, closes, next_t): how many starts and how
    many ends lie up to t, whether a period opens or closes there, and the next
    boundary.  Boundaries are counted per ms before the first
    shuffle, then dealt out by entity and chunk of time once: ranks within a chunk and
    the totals of chunks both start from there (nulls are left out first, so that both sides ask for the same exchange).  Totals of earlier chunks, one row per
    entity and chunk, are added, so that no task needs to hold an entity's boundaries.
    """
    side = lambda c, a, b: F.struct(F.col(c).alias("t"), F.lit(a).alias("ns"), F.lit(b).alias("ne"))
    points = (
        intervals.select(*keys, F.explode(F.array(side("s", 1, 0), side("e", 0, 1))).alias("p"))
        .select(*keys, F.col("p.t").alias("t"), F.floor(F.col("p.t") / chunk).alias("_chunk"), "p.ns", "p.ne")
        .where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in (*keys, "_chunk"))))
        .groupBy(*keys, "_chunk", "t")
        .agg(F.sum("ns").alias("ns"), F.sum("ne").alias("ne"))
        .repartition(*keys, "_chunk")
    )
    entity = Window.partitionBy(*keys).orderBy("_chunk")
    earlier = entity.rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        points.groupBy(*keys, "_chunk")
        .agg(F.sum("ns").alias("_s"), F.sum("ne").alias("_e"), F.min("t").alias("_first"))
        .select(*keys, "_chunk", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_s0"), F.coalesce(F.sum("_e").over(earlier), F.lit(0)).alias("_e0"), F.lead("_first").over(entity).alias("_next"))
    )
    within = Window.partitionBy(*keys, "_chunk").orderBy("t")
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    return (
        points.select("*", F.sum("ns").over(upto).alias("_s1"), F.sum("ne").over(upto).alias("_e1"), F.lead("t").over(within).alias("_t1"))
        .join(totals, [*keys, "_chunk"])
        .select(*keys, "_chunk", "t", "ns", "ne", (F.col("_s0") + F.col("_s1")).alias("starts"), (F.col("_e0") + F.col("_e1")).alias("ends"), F.coalesce("_t1", "_next").alias("next_t"))
        .withColumn("opens", F.col("starts") - F.col("ns") == F.col("ends") - F.col("ne"))
        .withColumn("closes", F.col("starts") == F.col("ends"))
    )


def gaps(intervals: DataFrame, keys: list[str], chunk: int = CHUNK_MS) -> DataFrame:
    """(keys..., gap_start, gap_end): from the end of each period to the start of the next of the same entity.

    Behind the k-th end lies a gap if the (k+1)-th start is later, that is, if just k
    starts lie up to it; the next boundary is then that start.

    ``intervals`` has keys, s and e (s < e, no nulls; see valid_intervals).  Intervals
    that overlap, nest, repeat or touch are one period.  Entities with one period, and
    empty tables, have no gaps.  Null keys belong to no entity.
    """
    return ranks(intervals, keys, chunk).where("closes AND next_t IS NOT NULL").select(*keys, F.col("t").alias("gap_start"), F.col("next_t").alias("gap_end"))


def periods(intervals: DataFrame, keys: list[str], chunk: int = CHUNK_MS) -> DataFrame:
    """(keys..., s, e): the continuous periods.

    A start opens a period if before it lie as many ends as starts; the end that
    closes it is the first behind which they are as many again.  Null keys belong to
    no entity, and empty tables have no periods.
    """
    edges = ranks(intervals, keys, chunk).where("opens OR closes")
    opening = F.when(F.col("opens"), F.col("t"))
    entity = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy(*keys, "_chunk").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    before = edges.groupBy(*keys, "_chunk").agg(F.max(opening).alias("_o")).select(*keys, "_chunk", F.max("_o").over(entity).alias("_o0"))
    return (
        edges.withColumn("_o1", F.max(opening).over(within))
        .where("closes")
        .join(before, [*keys, "_chunk"])
        .select(*keys, F.coalesce("_o1", "_o0").alias("s"), F.col("t").alias("e"))
    )


def speech_intervals(speakers: DataFrame, segments: DataFrame) -> DataFrame:
    """(video_id, speaker, src, s, e) of speakers.turns, speakers.exclusive_turns and the segments; rows without a speaker are left out."""
    keys = ["video_id", "speaker", "src"]
    known = "speaker IS NOT NULL AND trim(speaker) <> ''"
    lists = [
        valid_intervals(
            speakers.where(known).select("video_id", "speaker", F.lit(src).alias("src"), F.explode(src).alias("x")),
            keys,
            F.col("x.start"),
            F.col("x.end"),
        )
        for src in ("turns", "exclusive_turns")
    ]
    clips = valid_intervals(segments.where(known).withColumn("src", F.lit("segments")), keys, F.col("start"), F.col("end"))
    return reduce(DataFrame.unionByName, [*lists, clips])


def speech_gaps(speakers: DataFrame, segments: DataFrame) -> DataFrame:
    """The gaps of all entities (video_id, speaker, src), in ms."""
    return gaps(speech_intervals(speakers, segments), ["video_id", "speaker", "src"]).withColumnsRenamed({"gap_start": "gap_start_ms", "gap_end": "gap_end_ms"})


def speech_periods(speakers: DataFrame, segments: DataFrame) -> DataFrame:
    """The continuous periods of all entities (video_id, speaker, src), in ms."""
    return periods(speech_intervals(speakers, segments), ["video_id", "speaker", "src"]).withColumnsRenamed({"s": "start_ms", "e": "end_ms"})

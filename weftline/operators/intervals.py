"""Interval algebra on rows (keys..., s, e) with integer bounds.

Joins on overlap are equality joins on the keys and on bins of time, so that one
recording may hold any share of the rows; merging counts boundaries (see periods).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators import periods
from weftline.runtime import settle

#: Width of a bin of time in ms for overlap joins; an interval is copied into each bin that it touches.
BIN_MS = 60_000


def merge_close(intervals: DataFrame, keys: list[str], gap: int = 0) -> DataFrame:
    """Intervals of an entity merged where the next starts at most ``gap`` after the end reached so far.

    Gaps up to ``gap`` close when every end is moved by it, which turns the merge into
    that of periods.
    """
    moved = intervals.where("s IS NOT NULL AND e IS NOT NULL AND e >= s").select(*keys, "s", (F.col("e") + gap).alias("e"))
    return periods.periods(moved, keys).withColumn("e", F.col("e") - gap)


def merge_bounded(intervals: DataFrame, keys: list[str], gap: int = 0) -> DataFrame:
    """merge_close for entities that are small by their nature, such as the words of a clip: one window per entity."""
    w = Window.partitionBy(*keys).orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.where("s IS NOT NULL AND e IS NOT NULL AND e >= s").select(*keys, "s", "e", F.when(reach.isNull() | (F.col("s") - reach > gap), 1).otherwise(0).alias("_new"))
    numbered = marked.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_g").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_g")


def dilate(intervals: DataFrame, pad: int, floor: int | None = None) -> DataFrame:
    """Every interval longer by ``pad`` at both ends, its start not below ``floor``."""
    s = F.col("s") - pad
    return intervals.withColumns({"s": s if floor is None else F.greatest(s, F.lit(floor)), "e": F.col("e") + pad})


def _bins(df: DataFrame, s: str, e: str, width: int) -> DataFrame:
    return df.withColumn("__weft_bin", F.explode(F.sequence(F.floor(F.col(s) / width), F.greatest(F.floor(F.col(s) / width), F.floor(F.col(e) / width)))))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], width: int = BIN_MS) -> DataFrame:
    """Pairs of a left (s, e) and a right (rs, re) interval of equal keys with s < re and rs < e.

    Both sides are spread over bins; a pair is kept only in the bin in which its
    overlap starts, so it comes once.  ``right`` must have the columns rs and re and no
    others named as in ``left`` but the keys.
    """
    a, b = _bins(left, "s", "e", width), _bins(right, "rs", "re", width)
    settle(left.sparkSession)
    return a.join(b, [*keys, "__weft_bin"]).where("s < re AND rs < e").where(F.col("__weft_bin") == F.floor(F.greatest("s", "rs") / width)).drop("__weft_bin")


def touching(left: DataFrame, right: DataFrame, keys: list[str], width: int = BIN_MS) -> DataFrame:
    """Distinct left intervals that overlap (strictly) any right (rs, re) interval of equal keys."""
    return overlap_join(left, right, keys, width).select(*left.columns).distinct()


def meeting_others(left: DataFrame, turns: DataFrame, pad: int = 0, width: int = BIN_MS) -> DataFrame:
    """Pairs of a left (video_id, speaker, s, e) interval and another speaker's turn of the recording (rs, re), padded, that overlap.

    Joined by recording and bin, so turns are neither copied once per other speaker nor
    gathered by recording.
    """
    them = turns.select("video_id", F.col("speaker").alias("__weft_other"), (F.col("s") - pad).alias("rs"), (F.col("e") + pad).alias("re"))
    return overlap_join(left, them, ["video_id"], width).where(F.col("speaker") != F.col("__weft_other")).drop("__weft_other")


def overlap_ms(left: DataFrame, right: DataFrame, keys: list[str], name: str = "overlap_ms", width: int = BIN_MS) -> DataFrame:
    """``left`` with the sum of its overlaps with right (rs, re) intervals of equal keys; 0 where there is none.

    Repeated left rows come once.
    """
    own = left.distinct()
    return _summed(own, overlap_join(own, right, keys, width), name)


def others_ms(left: DataFrame, turns: DataFrame, pad: int = 0, name: str = "overlap_ms") -> DataFrame:
    """overlap_ms() with the turns of all other speakers of the recording."""
    own = left.distinct()
    return _summed(own, meeting_others(own, turns, pad), name)


def _summed(own: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    some = pairs.select(*own.columns, (F.least("e", "re") - F.greatest("s", "rs")).alias(name))
    return own.withColumn(name, F.lit(0).cast("bigint")).unionByName(some).groupBy(*own.columns).agg(F.sum(name).alias(name))


def subtract(keep: DataFrame, remove: DataFrame, keys: list[str], width: int = BIN_MS) -> DataFrame:
    """What is left of each kept interval without the removed ones of equal keys; removals may overlap.

    Pieces without length vanish, as do kept intervals without length.
    """
    own = keep.select(*keys, "s", "e").where("e > s").distinct()
    cut = remove.where("e > s").select(*keys, F.col("s").alias("rs"), F.col("e").alias("re")).distinct()
    return _left_over(own, overlap_join(own, cut, keys, width), keys)


def subtract_others(keep: DataFrame, turns: DataFrame, pad: int = 0) -> DataFrame:
    """What is left of each interval (video_id, speaker, s, e) without the padded turns of all other speakers of the recording."""
    keys = ["video_id", "speaker"]
    own = keep.select(*keys, "s", "e").where("e > s").distinct()
    return _left_over(own, meeting_others(own, turns.distinct(), pad), keys)


def _left_over(own: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The pieces of ``own`` intervals before, between and behind the removals (rs, re) that they are paired with.

    A piece ends where a removal begins beyond the ends of all before it; the end of the
    interval closes the last one.  A task sorts the removals of one interval at a time.
    """
    settle(own.sparkSession)
    marks = pairs.select(*keys, "s", "e", "rs", "re").unionByName(own.withColumns({"rs": F.col("e"), "re": F.col("e")}))
    before = F.max("re").over(Window.partitionBy(*keys, "s", "e").orderBy("rs", "re").rowsBetween(Window.unboundedPreceding, -1))
    pieces = marks.select(*keys, F.greatest("s", before).alias("_a"), F.least("rs", "e").alias("_b"))
    return pieces.where("_b > _a").select(*keys, F.col("_a").alias("s"), F.col("_b").alias("e"))


def others(turns: DataFrame, pad: int = 0) -> DataFrame:
    """(video_id, speaker, s, e): for each speaker the turns of all other speakers of the recording, padded."""
    who = turns.select("video_id", "speaker").distinct()
    them = turns.select("video_id", F.col("speaker").alias("other"), (F.col("s") - pad).alias("s"), (F.col("e") + pad).alias("e"))
    return who.join(them, "video_id").where("speaker <> other").select("video_id", "speaker", "s", "e")


def overlap_sweep(turns: DataFrame, keys: list[str], depth: int = 2, least: int = 300) -> DataFrame:
    """Regions in which at least ``depth`` turns run at once, of ``least`` ms or more.

    Turns count, not speakers.  At equal times ends come before starts, so turns that
    touch don't overlap and a region that is left and entered at once is two.
    """
    r = periods.ranks(turns.where("e > s"), keys)
    d0 = (F.col("starts") - F.col("ns")) - (F.col("ends") - F.col("ne"))
    mid, d1 = d0 - F.col("ne"), F.col("starts") - F.col("ends")
    edges = r.select(*keys, "_chunk", "t", ((d0 >= depth) & (mid < depth)).alias("closes"), ((mid < depth) & (d1 >= depth)).alias("opens")).where("opens OR closes")
    within = Window.partitionBy(*keys, "_chunk").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    entity = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    opening = F.when(F.col("opens"), F.col("t"))
    before = edges.groupBy(*keys, "_chunk").agg(F.max(opening).alias("_o")).select(*keys, "_chunk", F.max("_o").over(entity).alias("_o0"))
    return (
        edges.withColumn("_o1", F.max(opening).over(within))
        .where("closes")
        .join(before, [*keys, "_chunk"])
        .select(*keys, F.coalesce("_o1", "_o0").alias("s"), F.col("t").alias("e"))
        .where(F.col("e") - F.col("s") >= least)
    )


def suspects(turns: DataFrame, acoustic: DataFrame, pad: int = 400, least: int = 50, gap: int = 200) -> DataFrame:
    """Regions (video_id, speaker, s, e) where a speaker may not be alone.

    Overlaps of ``least`` ms with other speakers' padded turns, and acoustic overlaps
    (video_id, s, e) that touch the speaker's turns, merged across ``gap``.
    """
    one = meeting_others(turns, turns, pad).select("video_id", "speaker", F.greatest("s", "rs").alias("s"), F.least("e", "re").alias("e")).where(F.col("e") - F.col("s") >= least)
    heard = acoustic.select("video_id", F.col("s").alias("rs"), F.col("e").alias("re"))
    two = overlap_join(turns, heard, ["video_id"]).select("video_id", "speaker", F.col("rs").alias("s"), F.col("re").alias("e")).distinct()
    return merge_close(one.unionByName(two), ["video_id", "speaker"], gap)


def tiles(regions: DataFrame, keys: list[str], width: int = 10_000) -> DataFrame:
    """Distinct windows of ``width`` ms that the regions touch: (keys..., window)."""
    last = F.greatest(F.floor(F.col("s") / width), F.floor((F.col("e") - 1) / width))
    return regions.select(*keys, F.explode(F.sequence(F.floor(F.col("s") / width), last)).alias("window")).distinct()


def crosstalk_free(exclusive: DataFrame, turns: DataFrame, guard: int = 150, gap: int = 300, rescued: DataFrame | None = None) -> DataFrame:
    """A speaker's turns without the guarded turns of others (but for rescued regions), merged across ``gap``."""
    if not 0 <= guard <= 1000:
        raise ValueError("guard must be from 0 to 1000 ms")
    keys = ["video_id", "speaker"]
    if rescued is None:
        return merge_close(subtract_others(exclusive, turns, guard), keys, gap)
    return merge_close(subtract(exclusive, subtract(others(turns, guard), rescued, keys), keys), keys, gap)


def runs(frames: DataFrame, keys: list[str], at: str, active: str, least: int = 3, window: int | None = None) -> DataFrame:
    """(keys..., first, stop): runs of at least ``least`` active frames with successive numbers; stop is one beyond the last.

    With ``window`` frames are looked at so many at a time, as a model does, and no run goes beyond its window.
    """
    part = F.lit(0) if window is None else F.floor(F.col(at) / window)
    on = frames.where(F.col(active)).withColumn("_w", part)
    group = F.col(at) - F.row_number().over(Window.partitionBy(*keys, "_w").orderBy(at))
    return on.withColumn("_g", group).groupBy(*keys, "_w", "_g").agg(F.min(at).alias("first"), (F.max(at) + 1).alias("stop")).drop("_w", "_g").where(F.col("stop") - F.col("first") >= least)


def chunk_plan(turns: DataFrame, keys: list[str], longest: int = 60_000, block_gap: int = 1_000, break_gap: int = 4_000, settled: int = 20_000) -> DataFrame:
    """(keys..., k, s, e): utterance blocks packed greedily into chunks that break in long silences.

    Blocks are turns merged across ``block_gap``; a chunk ends before a block that would
    make it longer than ``longest``, or behind a gap of ``break_gap`` once it is
    ``settled`` long.  Every decision depends on the one before, so an entity's blocks
    are folded, and only finished chunks are kept on the way; merged blocks are at least block_gap apart, so their number
    is bounded by the length of the recording, not by the number of rows.
    """
    blocks = merge_close(turns, keys, block_gap).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("b"))
    fold = f"""
      aggregate(b, named_struct('s', cast(null as bigint), 'e', cast(null as bigint), 'done', cast(array() as array<struct<s:bigint,e:bigint>>)), (acc, x) ->
        CASE WHEN acc.s IS NULL THEN named_struct('s', x.s, 'e', x.e, 'done', acc.done)
             WHEN x.e - acc.s > {longest} OR (x.s - acc.e >= {break_gap} AND acc.e - acc.s >= {settled})
             THEN named_struct('s', x.s, 'e', x.e, 'done', concat(acc.done, array(named_struct('s', acc.s, 'e', acc.e))))
             ELSE named_struct('s', acc.s, 'e', x.e, 'done', acc.done) END,
        acc -> concat(acc.done, array(named_struct('s', acc.s, 'e', acc.e))))"""
    return blocks.select(*keys, F.posexplode(F.expr(fold)).alias("k", "c")).select(*keys, "k", "c.s", "c.e")


def as_of(points: DataFrame, words: DataFrame, keys: list[str], chunk: int = periods.CHUNK_MS) -> DataFrame:
    """``points`` (keys..., t) with prev_end, the greatest word end below t, and next_start, the least word start above t.

    Boundaries are sorted within chunks of time; what lies in earlier and later chunks
    is carried over from a table with one row per chunk.  Null where there is none.
    """
    p = points.select(*keys, "t").distinct()
    settle(points.sparkSession)
    rows = (
        p.select(*keys, "t", F.lit(True).alias("_p"), F.lit(None).cast("long").alias("_e"), F.lit(None).cast("long").alias("_s"))
        .unionByName(words.select(*keys, F.col("e").alias("t"), F.lit(False).alias("_p"), F.col("e").alias("_e"), F.lit(None).cast("long").alias("_s")))
        .unionByName(words.select(*keys, F.col("s").alias("t"), F.lit(False).alias("_p"), F.lit(None).cast("long").alias("_e"), F.col("s").alias("_s")))
        .withColumn("_chunk", F.floor(F.col("t") / chunk))
        .groupBy(*keys, "_chunk", "t")
        .agg(F.max("_p").alias("_p"), F.max("_e").alias("_e"), F.min("_s").alias("_s"))
    )
    entity = Window.partitionBy(*keys).orderBy("_chunk")
    carried = (
        rows.groupBy(*keys, "_chunk")
        .agg(F.max("_e").alias("_ce"), F.min("_s").alias("_cs"))
        .select(
            *keys, "_chunk",
            F.max("_ce").over(entity.rowsBetween(Window.unboundedPreceding, -1)).alias("_e0"),
            F.min("_cs").over(Window.partitionBy(*keys).orderBy(F.col("_chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)).alias("_s0"),
        )
    )
    up, down = Window.partitionBy(*keys, "_chunk").orderBy("t"), Window.partitionBy(*keys, "_chunk").orderBy(F.col("t").desc())
    return (
        rows.withColumn("_e1", F.max("_e").over(up.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("_s1", F.min("_s").over(down.rowsBetween(Window.unboundedPreceding, -1)))
        .where("_p")
        .join(carried, [*keys, "_chunk"])
        .select(*keys, "t", F.coalesce("_e1", "_e0").alias("prev_end"), F.coalesce("_s1", "_s0").alias("next_start"))
    )


def clipped_to(regions: DataFrame, windows: DataFrame, keys: list[str], window: str = "window", width: int = BIN_MS) -> DataFrame:
    """(keys..., window, s, e): the parts of ``regions`` inside each window (keys, window, s, e), in time from the window's start."""
    w = windows.select(*keys, window, F.col("s").alias("rs"), F.col("e").alias("re"))
    inside = overlap_join(regions.select(*keys, "s", "e"), w, keys, width)
    return inside.select(*keys, window, (F.greatest("s", "rs") - F.col("rs")).alias("s"), (F.least("e", "re") - F.col("rs")).alias("e"))


def speech_islands(speech: DataFrame, words: DataFrame, keys: list[str], pad: int = 120, gap: int = 50, least: int = 300) -> DataFrame:
    """(keys..., s, e): speech of ``least`` ms or more that no word covers; words are padded, not below 0, and merged across ``gap``."""
    cover = merge_bounded(dilate(words.select(*keys, "s", "e"), pad, 0), keys, gap)
    return subtract(speech, cover, keys).where(F.col("e") - F.col("s") >= least)


def paste_regions(suspect: DataFrame, turns: DataFrame, keys: list[str], width: int = 10_000, least: int = 20, pad: int = 100, gap: int = 50) -> DataFrame:
    """(keys..., window, s, e): where separated audio replaces the original, per window of ``width`` ms.

    The parts of suspect regions inside a window that are the speaker's own speech for
    more than ``least`` ms, padded within the window and merged across ``gap``.
    """
    last = F.floor((F.col("e") - 1) / width)
    tiled = suspect.where("e > s").select(*keys, "s", "e", F.explode(F.sequence(F.floor(F.col("s") / width), last)).alias("window"))
    cut = tiled.select(*keys, "window", F.greatest("s", F.col("window") * width).alias("s"), F.least("e", (F.col("window") + 1) * width).alias("e"))
    own = turns.select(*keys, F.col("s").alias("rs"), F.col("e").alias("re"))
    part = overlap_join(cut, own, keys).select(*keys, "window", F.greatest("s", "rs").alias("s"), F.least("e", "re").alias("e")).where(F.col("e") - F.col("s") > least)
    padded = part.select(*keys, "window", F.greatest(F.col("s") - pad, F.col("window") * width).alias("s"), F.least(F.col("e") + pad, (F.col("window") + 1) * width).alias("e"))
    return merge_bounded(padded, [*keys, "window"], gap)

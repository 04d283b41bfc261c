"""Clean lanes: windows of separated speech, whether they are pure, and what must not be cut.

Windows are rows (keys..., window) of ``width`` ms; a window has several streams of
separated audio, of which the one most like its speaker counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import half_up
from weftline.operators import intervals, signals
from weftline.runtime import checkpoint, settle

KEYS = ["video_id", "speaker"]
# The least likeness of a pure window, the level below which it is silent, and the room around rescued speech, in ms.
PURE, SILENT, RESCUE_MS = 0.55, 0.003, 60


def verdicts(streams: DataFrame, keys: list[str], least: float = PURE, silent: float = SILENT) -> DataFrame:
    """(keys..., window, stream, purity, pass) of each window: its stream most like the speaker, the first of equal ones.

    ``streams`` has keys, window, stream, similarity and rms.  A silent stream is pure;
    one without similarity (too little speech) is unknown, so pass is null.  Windows
    whose streams are all unknown keep their first stream.
    """
    ranked = streams.select(*keys, "window", F.struct(F.coalesce("similarity", F.lit(-2.0)).alias("s"), (-F.col("stream")).alias("n"), "rms").alias("m"))
    best = ranked.groupBy(*keys, "window").agg(F.max("m").alias("m"))
    purity = F.when(F.col("m.rms") < silent, 1.0).when(F.col("m.s") > -2, half_up(F.col("m.s"), 3))
    return best.select(*keys, "window", (-F.col("m.n")).alias("stream"), purity.alias("purity")).withColumn("pass", F.col("purity") >= least)


def rescued(suspect: DataFrame, turns: DataFrame, verdict: DataFrame, keys: list[str] | None = None, width: int = 10_000) -> DataFrame:
    """(keys..., s, e): the speaker's own speech in suspect regions that separated audio replaces, in windows that passed."""
    keys = keys or KEYS
    pasted = intervals.paste_regions(suspect, turns, keys, width)
    good = verdict.where(F.col("pass")).select(*keys, "window")
    return intervals.merge_close(pasted.join(good, [*keys, "window"], "left_semi"), keys, 50)


def forbidden(verdict: DataFrame, saved: DataFrame, keys: list[str] | None = None, width: int = 10_000, pad: int = RESCUE_MS) -> DataFrame:
    """(keys..., s, e) that no clip of a clean lane may touch: windows that failed, and rescued speech with ``pad`` ms around it; a window whose purity is unknown isn't forbidden."""
    keys = keys or KEYS
    settle(verdict.sparkSession)
    failed = verdict.where(~F.col("pass")).select(*keys, (F.col("window") * width).alias("s"), ((F.col("window") + 1) * width).alias("e"))
    return intervals.merge_close(failed.unionByName(intervals.dilate(saved, pad).select(*keys, "s", "e")), keys)


def forbidden_masked(turns: DataFrame, guard: int = 150) -> DataFrame:
    """(video_id, speaker, s, e) that no clip of a masked lane may touch: all other speakers' turns with ``guard`` ms around them."""
    return intervals.merge_close(intervals.others(turns, guard), KEYS)


def clean_lane(turns: DataFrame, acoustic: DataFrame, separate: Callable[[DataFrame], DataFrame]) -> dict[str, DataFrame]:
    """What a clean lane is made of, by name: suspect regions, windows with their verdict, rescued speech, forbidden regions.

    ``acoustic`` are overlaps that were heard (video_id, s, e).  ``separate`` gets the
    suspect windows (video_id, speaker, window) and gives the streams that a separation
    model and a speaker embedding find there (see verdicts); it is called once.
    """
    suspect = checkpoint(intervals.suspects(turns, acoustic))
    verdict = checkpoint(verdicts(separate(intervals.tiles(suspect, KEYS)), KEYS))
    saved = checkpoint(rescued(suspect, turns, verdict))
    return {"suspect": suspect, "windows": verdict, "rescued": saved, "forbidden": forbidden(verdict, saved)}


def levels(clips: DataFrame, saved: DataFrame, longest: int = 20_000, least: int = 50) -> DataFrame:
    """``clips`` (keys..., s, e and more) with over_len, separated_s, separated and separated_frac: how much of each is rescued speech."""
    parts = saved.select(*KEYS, F.col("s").alias("rs"), F.col("e").alias("re"))
    ms: Column = F.col("_ms")
    length = F.col("e") - F.col("s")
    return intervals.overlap_ms(clips, parts, KEYS, "_ms").select(
        *clips.columns, (length > longest).alias("over_len"), half_up(ms / 1000, 2).alias("separated_s"), (ms > least).alias("separated"), F.coalesce(half_up(ms / F.nullif(length, F.lit(0)), 3), F.lit(0.0)).alias("separated_frac")
    )


def solo_centroids(embeddings: DataFrame, turns: DataFrame, dims: int, longest: int = 5_000) -> DataFrame:
    """(video_id, speaker, centroid) from the embeddings of each speaker's solo turns: the first eight of a second or more, else the four longest.

    ``embeddings`` has video_id, speaker, s and embedding of solo turns, each of at most
    ``longest`` ms of audio from its start; see solo_snippets for what to embed.
    """
    chosen = solo_snippets(turns, longest).select(*KEYS, "s")
    named = embeddings.join(chosen, [*KEYS, "s"], "left_semi").withColumn("_who", F.struct(*KEYS))
    return signals.centroids(named, "_who", "embedding", dims).select("_who.*", "centroid")


def solo_snippets(turns: DataFrame, longest: int = 5_000) -> DataFrame:
    """(video_id, speaker, s, e): the solo turns that stand for a speaker, cut to ``longest`` ms."""
    return signals.longest_first(intervals.subtract_others(turns, turns), KEYS).select(*KEYS, "s", F.least("e", F.col("s") + longest).alias("e"))

"""Detectors that compare a clip with its speaker's other clips.

A speaker may own any share of the rows: values are counted before the shuffle and
cumulated in ranges of values, so no task needs to hold a speaker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import half_up


def running(points: DataFrame, keys: list[str], at: str, n: str, width: float) -> DataFrame:
    """``points`` (keys, at, n) with ``upto``, the sum of n of the entity up to and including ``at``.

    The sum within a range of ``width`` and the sum of earlier ranges are added.
    """
    ranged = points.withColumn("_chunk", F.floor(F.col(at) / width))
    earlier = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    before = ranged.groupBy(*keys, "_chunk").agg(F.sum(n).alias("_n")).withColumn("_before", F.coalesce(earlier, F.lit(0))).drop("_n")
    within = F.sum(n).over(Window.partitionBy(*keys, "_chunk").orderBy(at).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("_in", within).join(before, [*keys, "_chunk"]).withColumn("upto", F.col("_in") + F.col("_before")).drop("_chunk", "_in", "_before")


def strict_percentile(rows: DataFrame, keys: list[str], value: str, name: str, fewest: int = 10, width: float = 0.001) -> DataFrame:
    """``rows`` with the share of the entity's values that are smaller; one half if it has fewer than ``fewest``.

    Null and NaN values have a null percentile and aren't counted.  ``width`` is the
    range of values cumulated in one task.
    """
    x = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    counts = rows.select(*keys, x.alias("__weft_x")).where("__weft_x IS NOT NULL").groupBy(*keys, "__weft_x").agg(F.count("*").alias("__weft_c"))
    below = running(counts, keys, "__weft_x", "__weft_c", width).select(*keys, "__weft_x", (F.col("upto") - F.col("__weft_c")).alias("__weft_below"))
    total = counts.groupBy(*keys).agg(F.sum("__weft_c").alias("__weft_all"))
    share = below.join(total, keys).select(*keys, "__weft_x", F.when(F.col("__weft_all") < fewest, 0.5).otherwise(F.col("__weft_below") / F.col("__weft_all")).alias(name))
    return rows.withColumn("__weft_x", x).join(share, [*keys, "__weft_x"], "left").drop("__weft_x")


def whispers(features: DataFrame, keys: list[str], voiced_most: float = 0.25, percentile: float = 0.20) -> DataFrame:
    """(seg_id, score, voiced, rms): hardly voiced clips that aren't quieter than most: rms at or above the percentile of positive values of the job, which ``keys`` name."""
    known = features.where("rms > 0").groupBy(*keys, "rms").agg(F.count("*").alias("_c"))
    floor = known.groupBy(*keys).agg(F.percentile("rms", F.lit(percentile), F.col("_c")).alias("floor"))
    at = features.join(floor, keys, "left") if keys else features.join(F.broadcast(floor))
    return at.where((F.col("rms") >= F.coalesce("floor", F.lit(0.0))) & (F.col("voiced") <= voiced_most)).select("seg_id", half_up(1 - F.col("voiced"), 3).alias("score"), "voiced", "rms")


def tones(features: DataFrame, keys: list[str], fewest: int = 20, flat: float = 0.10, cheer: float = 0.90) -> DataFrame:
    """(seg_id, tag, score, f0_mean, f0_std, p_mean, p_std): flatly in the lowest tenth of pitch variation, cheerfully in the highest of pitch with ample variation.

    Speakers with fewer than ``fewest`` clips, clips without pitch and whispered ones are left out.
    """
    many = features.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= fewest).select(*keys)
    both = strict_percentile(strict_percentile(features.join(many, keys, "left_semi"), keys, "f0_std", "p_std", width=0.05), keys, "f0_mean", "p_mean", width=5.0)
    usable = both.where("f0_std IS NOT NULL AND f0_mean IS NOT NULL AND coalesce(voiced, 1) >= 0.25")
    flatly = F.col("p_std") <= flat
    cheerful = ~flatly & (F.col("p_mean") >= cheer) & (F.col("p_std") >= 0.6)
    return usable.where(flatly | cheerful).select(
        "seg_id",
        F.when(flatly, "flatly").otherwise("cheerfully").alias("tag"),
        F.when(flatly, half_up(1.0 - F.col("p_std") / flat * 0.5, 3)).otherwise(half_up(0.5 + (F.col("p_mean") - cheer) / (1 - cheer) * 0.5, 3)).alias("score"),
        "f0_mean", "f0_std", "p_mean", "p_std",
    )


def _regions(a: Column, v: Column, unstable: Column) -> list[tuple[str, Column, Column]]:
    half = lambda x, most: x / most * 0.5
    return [
        ("excited", (a >= 0.8) & (v >= 0.6), half(a - 0.8, 0.2) + half(v - 0.6, 0.4)),
        ("nervous", (a >= 0.8) & (v <= 0.4) & unstable, half(a - 0.8, 0.2) + half(0.4 - v, 0.4)),
        ("frustrated", (a >= 0.6) & (v <= 0.3), half(a - 0.6, 0.4) + half(0.3 - v, 0.3)),
        ("sorrowful", (a <= 0.3) & (v <= 0.3), half(0.3 - a, 0.3) + half(0.3 - v, 0.3)),
        ("calm", (a <= 0.3) & (v >= 0.6), half(0.3 - a, 0.3) + half(v - 0.6, 0.4)),
    ]


def states(features: DataFrame, keys: list[str], fewest: int = 20) -> DataFrame:
    """(seg_id, tag, score, arousal, valence, pa, pv): states by where arousal and valence stand among the speaker's; several may hold.

    Needs ``fewest`` scored clips of a speaker; nervous also needs a pitch variation
    above the speaker's upper quartile.
    """
    scored = features.where("arousal IS NOT NULL AND valence IS NOT NULL")
    many = scored.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= fewest).select(*keys)
    quartile = features.where("f0_std IS NOT NULL").groupBy(*keys, "f0_std").agg(F.count("*").alias("_c")).groupBy(*keys).agg(F.percentile("f0_std", F.lit(0.75), F.col("_c")).alias("_q"))
    p = strict_percentile(strict_percentile(scored.join(many, keys, "left_semi"), keys, "arousal", "pa", width=0.05), keys, "valence", "pv", width=0.05)
    unstable = F.coalesce(F.col("f0_std") > F.coalesce("_q", F.lit(1e9)), F.lit(False))
    hits = F.array_compact(F.array(*(F.when(cond, F.struct(F.lit(t).alias("tag"), half_up(F.least(F.lit(1.0), 0.3 + s), 3).alias("score"))) for t, cond, s in _regions(F.col("pa"), F.col("pv"), unstable))))
    return p.join(quartile, keys, "left").select("seg_id", "arousal", "valence", "pa", "pv", F.explode(hits).alias("h")).select("seg_id", "h.tag", "h.score", "arousal", "valence", "pa", "pv")

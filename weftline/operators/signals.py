"""Frames of a signal, and embeddings of clips."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import vectors
from weftline.functions.text import half_up


def frame_rms(samples: DataFrame, keys: list[str], frame: int) -> DataFrame:
    """(keys..., f, rms): root of the mean square of each whole frame of ``frame`` samples (i, x); an incomplete last frame is left out."""
    return samples.groupBy(*keys, F.floor(F.col("i") / frame).alias("f")).agg(F.count("*").alias("_n"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms")).where(F.col("_n") == frame).drop("_n")


def peaks(samples: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """(keys..., bin, low, high): the envelope in bins of max(1, n // bins) samples; the rest at the end is left out, so there may be more than ``bins``."""
    n = samples.groupBy(*keys).agg(F.count("*").alias("_n")).withColumn("_hop", F.greatest(F.lit(1), F.floor(F.col("_n") / bins)))
    at = samples.join(n, keys).where(F.col("i") < F.floor(F.col("_n") / F.col("_hop")) * F.col("_hop"))
    return at.groupBy(*keys, F.floor(F.col("i") / F.col("_hop")).alias("bin")).agg(F.min("x").alias("low"), F.max("x").alias("high"))


def active_frames(frames: DataFrame, keys: list[str], value: str = "rms") -> DataFrame:
    """``frames`` with active: above three times the clip's 10th percentile and above a twentieth of its maximum."""
    limit = frames.groupBy(*keys).agg(F.percentile(value, F.lit(0.1)).alias("_low"), F.max(value).alias("_high"))
    return frames.join(limit, keys).withColumn("active", F.col(value) > F.greatest(F.col("_low") * 3, F.col("_high") * 0.05)).drop("_low", "_high")


def event_peak(scores: DataFrame, keys: list[str], classes: list[str], least: float) -> DataFrame:
    """(keys..., score, frame, best): the greatest score over classes and frames, the first frame that has it, and the greatest of each class.

    Clips whose greatest score is below ``least`` are left out.
    """
    named = [F.col(f"`{c}`") for c in classes]
    top = F.greatest(*named) if len(classes) > 1 else named[0]
    best = F.max(F.struct(top.alias("score"), (-F.col("f")).alias("f")))
    return (
        scores.groupBy(*keys)
        .agg(best.alias("m"), *(F.max(c).alias(n) for c, n in zip(named, classes)))
        .where(F.col("m.score") >= least)
        .select(*keys, F.col("m.score").alias("score"), (-F.col("m.f")).alias("frame"), *named)
    )


def centroids(embeddings: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """(key, centroid): the unit vector of the mean of the unit vectors; unusable vectors have no part.

    Summed dimension by dimension with a partial sum on every task, whatever the size of a group.
    """
    u = embeddings.where(vectors.usable(F.col(vector))).select(key, vectors.unit(F.col(vector)).alias("_u"))
    mean = u.groupBy(key).agg(*(F.avg(F.get("_u", F.lit(d))).alias(f"_{d}") for d in range(dims)))
    return mean.select(key, vectors.unit(F.array(*(f"_{d}" for d in range(dims)))).alias("centroid"))


def purity(embeddings: DataFrame, centroid: DataFrame, key: str, vector: str, least: float = 0.55, quiet: str | None = None) -> DataFrame:
    """``embeddings`` with purity, the cosine with its centroid, and pass; a silent clip (``quiet``) is pure, an unusable vector is unknown."""
    u = F.when(vectors.usable(F.col(vector)), vectors.dot(vectors.unit(F.col(vector)), F.col("centroid")))
    p = F.when(F.col(quiet), 1.0).otherwise(u) if quiet else u
    return embeddings.join(centroid, key, "left").withColumn("purity", p).withColumn("pass", F.col("purity") >= least).drop("centroid")


def nearest(streams: DataFrame, keys: list[str], similarity: str, number: str) -> DataFrame:
    """Of each group the stream most similar; the first of equal ones."""
    return streams.groupBy(*keys).agg(F.max(F.struct(F.col(similarity).alias("s"), (-F.col(number)).alias("n"))).alias("m")).select(*keys, (-F.col("m.n")).alias(number), F.col("m.s").alias(similarity))


def longest_first(turns: DataFrame, keys: list[str], k: int = 8, least: int = 1000, spare: int = 4) -> DataFrame:
    """The first ``k`` turns of at least ``least`` ms of each entity, or its ``spare`` longest if it has none."""
    w = Window.partitionBy(*keys)
    long = turns.where(F.col("e") - F.col("s") >= least).withColumn("_r", F.row_number().over(w.orderBy("s", "e"))).where(F.col("_r") <= k).drop("_r")
    none = turns.join(long.select(*keys).distinct(), keys, "left_anti")
    return long.unionByName(none.withColumn("_r", F.row_number().over(w.orderBy((F.col("e") - F.col("s")).desc(), "s"))).where(F.col("_r") <= spare).drop("_r"))


def rms_rounded(frames: DataFrame, places: int = 6) -> DataFrame:
    return frames.withColumn("rms", half_up(F.col("rms"), places))


def prosody(frames: DataFrame, keys: list[str], clips: DataFrame) -> DataFrame:
    """(keys..., f0_mean, f0_std_st, voiced_ratio, rms, rate_wps) of clips.

    ``frames`` has f0, voiced and rms per frame and active (see active_frames); ``clips``
    has keys, n_words and dur in seconds.  The deviation is that of semitones and needs
    more than three voiced frames; ratio and level count active frames only and are 0
    without any; the rate is null without words.
    """
    heard = F.col("voiced") & F.col("f0").isNotNull() & ~F.isnan("f0")
    f0, semitone = F.when(heard, F.col("f0")), F.when(heard, 12 * F.log2("f0"))
    stats = frames.groupBy(*keys).agg(
        half_up(F.avg(f0), 2).alias("f0_mean"),
        F.when(F.count(f0) > 3, half_up(F.stddev_pop(semitone), 3)).alias("f0_std_st"),
        F.coalesce(half_up(F.avg(F.when(F.col("active"), F.col("voiced").cast("double"))), 3), F.lit(0.0)).alias("voiced_ratio"),
        F.coalesce(half_up(F.avg(F.when(F.col("active"), F.col("rms"))), 5), F.lit(0.0)).alias("rms"),
    )
    rate = half_up(F.nullif(F.col("n_words"), F.lit(0)) / F.col("dur"), 2)
    return stats.join(clips.select(*keys, rate.alias("rate_wps")), keys, "left")

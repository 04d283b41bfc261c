"""Detectors as functions from tables to candidate rows, by name.

A candidate row is (seg_id, tag, score, detector, position_s, evidence), evidence
being JSON whose fields depend on the rule.  ``tables`` gives each detector what it
names: words (seg_id, i, w, s, e), islands (seg_id, s, e), features (seg_id, video_id,
speaker, f0_mean, f0_std, voiced, rms, arousal, valence), frames (seg_id, f, one column
per sound class) with clips (seg_id, dur_ms).  Features without video_id are those of a
single recording.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import half_up
from weftline.operators import percentiles, signals, words
from weftline.runtime import settle

COLUMNS = ["seg_id", "tag", "score", "detector", "position_s", "evidence"]
KEY = ["seg_id"]
# Least score of a sound event worth a row, and the shortest clip searched.
EMIT = {"laughs": 0.05, "sigh": 0.03, "gasps": 0.03}
LEAST_MS = 250


def _rows(df: DataFrame, tag: Column, detector: str, at_ms: Column | None, evidence: Column) -> DataFrame:
    position = F.lit(None).cast("double") if at_ms is None else half_up(at_ms / 1000, 2)
    return df.select("seg_id", tag.alias("tag"), "score", F.lit(detector).alias("detector"), position.alias("position_s"), F.to_json(evidence).alias("evidence"))


def _seconds(c: str | Column) -> Column:
    return half_up((F.col(c) if isinstance(c, str) else c) / 1000, 2)


def beats(tables: dict[str, DataFrame]) -> DataFrame:
    """Pauses, hesitations and stammers by rules on words and islands."""
    w, i = tables["words"], tables["islands"]
    settle(w.sparkSession)
    name = "beats_rules"
    quiet = words.silent_pauses(w, i, KEY, named=True)
    slow = words.hesitations(w, i, KEY, named=True)
    again = words.stammers(w, KEY).withColumn("score", F.lit(0.7))
    burst = words.island_clusters(i, KEY, named=True).withColumn("score", F.lit(0.5))
    bounds = lambda x: F.array(_seconds(x["s"]), _seconds(x["e"]))
    island = F.when(F.col("kind") == "island", bounds({"s": F.col("s"), "e": F.col("e")}))
    parts = [
        _rows(quiet, F.lit("pauses"), name, F.col("mid"), F.struct(_seconds("gap").alias("gap_s"), "after_word", "before_word")),
        _rows(slow, F.lit("hesitates"), name, F.col("at"), F.struct("filler", _seconds("gap").alias("gap_s"), island.alias("island"), F.when(F.col("kind") == "island", "unaligned_island").alias("kind"))),
        _rows(again, F.lit("stammers"), name, F.col("at"), F.struct(F.col("word").alias("repeated"), _seconds("gap").alias("join_s"))),
        _rows(burst, F.lit("stammers"), name, F.col("at"), F.struct(F.transform("cluster", bounds).alias("island_cluster"))),
    ]
    return reduce(DataFrame.unionByName, parts)


def _keys(features: DataFrame, *more: str) -> list[str]:
    """What percentiles are relative to: speakers' labels hold within a recording only."""
    return [*(["video_id"] if "video_id" in features.columns else []), *more]


def whispers(tables: dict[str, DataFrame]) -> DataFrame:
    f = tables["features"]
    return _rows(percentiles.whispers(f, _keys(f)), F.lit("whispers"), "voicing_ratio", None, F.struct(half_up(F.col("voiced"), 3).alias("voiced_ratio"), half_up(F.col("rms"), 5).alias("rms")))


def tones(tables: dict[str, DataFrame]) -> DataFrame:
    f = tables["features"]
    flat, three = F.col("tag") == "flatly", lambda c: half_up(F.col(c), 3)
    evidence = F.struct(
        F.when(~flat, half_up(F.col("f0_mean"), 2)).alias("f0_mean"), three("f0_std").alias("f0_std_st"),
        F.when(flat, three("p_std")).alias("pctl_in_speaker"), F.when(~flat, three("p_mean")).alias("pctl_mean"), F.when(~flat, three("p_std")).alias("pctl_std"),
    )
    return _rows(percentiles.tones(f, _keys(f, "speaker")), F.col("tag"), "prosody_percentile", None, evidence)


def states(tables: dict[str, DataFrame]) -> DataFrame:
    f = tables["features"]
    three = lambda c, name: half_up(F.col(c), 3).alias(name)
    evidence = F.struct(three("arousal", "arousal"), three("valence", "valence"), three("pa", "pctl_a"), three("pv", "pctl_v"), F.lit(True).alias("weak"))
    return _rows(percentiles.states(f, _keys(f, "speaker")), F.col("tag"), "arousal_valence_percentile", None, evidence)


def sounds(tables: dict[str, DataFrame], classes: dict[str, list[str]]) -> DataFrame:
    """Sound events by tag: the loudest frame over those of the tag's classes that ``frames`` has, in clips of LEAST_MS or more."""
    frames = tables["frames"]
    settle(frames.sparkSession)
    known = tables["clips"].where(F.col("dur_ms") >= LEAST_MS)
    length = frames.groupBy(*KEY).agg((F.max("f") + 1).alias("_n")).join(known, KEY)
    parts = []
    present = {tag: [c for c in names if c in frames.columns] for tag, names in classes.items()}
    for tag, names in present.items():
        if not names:
            continue
        peak = signals.event_peak(frames, KEY, names, EMIT.get(tag, 0.0)).join(length, KEY)
        shaped = peak.withColumn("score", half_up(F.col("score"), 3))
        parts.append(_rows(shaped, F.lit(tag), "sound_events", F.col("frame") * F.col("dur_ms") / F.col("_n"), F.struct(F.struct(*(half_up(F.col(f"`{c}`"), 3).alias(c) for c in names)).alias("class_scores"))))
    return reduce(DataFrame.unionByName, parts) if parts else frames.sparkSession.createDataFrame([], "seg_id string, tag string, score double, detector string, position_s double, evidence string")


# The sound classes of each tag, as models of sound events name them.
LAUGHS = {"laughs": ["Laughter", "Giggle", "Snicker", "Belly laugh", "Chuckle, chortle"]}
REACTIONS = {"sigh": ["Sigh"], "gasps": ["Gasp"]}


def laughs(tables: dict[str, DataFrame]) -> DataFrame:
    return sounds(tables, LAUGHS)


def reactions(tables: dict[str, DataFrame]) -> DataFrame:
    return sounds(tables, REACTIONS)


REGISTRY: dict[str, Callable[[dict[str, DataFrame]], DataFrame]] = {"laughs": laughs, "beats": beats, "whispers": whispers, "tones": tones, "states": states, "reactions": reactions}


def register(name: str, detector: Callable[[dict[str, DataFrame]], DataFrame]) -> None:
    """Add a detector, or replace one."""
    REGISTRY[name] = detector


def detect(tables: dict[str, DataFrame], names: list[str] | None = None) -> DataFrame:
    """The candidates of all named detectors, with detector_name."""
    chosen = sorted(REGISTRY) if names is None else names
    if unknown := [n for n in chosen if n not in REGISTRY]:
        raise KeyError(f"unknown detectors {unknown}")
    parts = []
    for n in chosen:
        rows = REGISTRY[n](tables)
        if rows.columns != COLUMNS:
            raise ValueError(f"{n} gives {rows.columns}")
        parts.append(rows.withColumn("detector_name", F.lit(n)))
    return reduce(DataFrame.unionByName, parts)


def chip_label(tag: Column, score: Column, evidence: Column) -> Column:
    """What tells most about a hit: the length of a gap or an island, the filler or the repeated word, the number of islands, else the score."""
    field = lambda f: F.get_json_object(evidence, f"$.{f}")
    two = lambda x: F.when(x.isNotNull(), F.format_string("%.2f", half_up(x, 2)))
    quoted = lambda f: F.concat(F.lit('"'), field(f), F.lit('"'))
    gap = F.try_to_number(field("gap_s"), F.lit("999999.999")).cast("double")
    island = field("island[1]").cast("double") - field("island[0]").cast("double")
    cluster = F.json_array_length(field("island_cluster"))
    return (
        F.when((tag == "pauses") & gap.isNotNull(), F.concat(two(gap), F.lit("s")))
        .when((tag == "hesitates") & field("filler").isNotNull(), quoted("filler"))
        .when((tag == "hesitates") & field("island").isNotNull(), F.concat(two(island), F.lit("s")))
        .when((tag == "stammers") & field("repeated").isNotNull(), quoted("repeated"))
        .when((tag == "stammers") & cluster.isNotNull(), F.concat(cluster.cast("string"), F.lit("×")))
        .otherwise(two(score))
    )


def chip_title(tag: Column, score: Column, detector: Column, evidence: Column) -> Column:
    """Lines that tell where a hit comes from: detector, score, and what the evidence says in words."""
    field = lambda f: F.get_json_object(evidence, f"$.{f}")
    said = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("?")) for p in parts))
    # The wording of each line.
    length = F.format_string("%.2f", half_up(field("island[1]").cast("double") - field("island[0]").cast("double"), 2))
    detail = (
        F.when((tag == "pauses") & field("gap_s").isNotNull(), said(field("gap_s"), 's of silence between "', field("after_word"), '" and "', field("before_word"), '"'))
        .when((tag == "hesitates") & field("filler").isNotNull(), said('filler "', field("filler"), '" beside a ', field("gap_s"), "s gap"))
        .when((tag == "hesitates") & field("island").isNotNull(), said(length, "s of speech with no transcript"))
        .when((tag == "stammers") & field("repeated").isNotNull(), said('"', field("repeated"), '" repeated ', field("join_s"), "s apart"))
        .when(field("class_scores").isNotNull(), said("class scores: ", field("class_scores")))
        .when(field("arousal").isNotNull(), F.concat(said("arousal ", field("arousal"), " (pctl ", field("pctl_a"), ") · valence ", field("valence"), " (pctl ", field("pctl_v"), ")"), F.when(field("weak") == "true", " · WEAK evidence (English-trained model on Hindi)").otherwise("")))
        .when(field("f0_std_st").isNotNull(), said("pitch variability ", field("f0_std_st"), " semitones (speaker pctl ", F.coalesce(field("pctl_in_speaker"), field("pctl_std")), ")"))
    )
    return F.concat_ws("\n", F.concat(F.lit("detector: "), detector), F.when(score.isNotNull(), F.concat(F.lit("score: "), F.format_string("%.3f", half_up(score, 3)))), detail, F.lit("click to play ±2s around it"))


def matched_tokens(rows: DataFrame, tokens: str = "tokens", aligned: str = "words", name: str = "matched") -> DataFrame:
    """``rows`` with the token numbers of aligned words that carry none: each word takes the next equal token, in order.

    A fold over the tokens of a row; words behind one that finds no token stay unmatched.
    """
    fold = f"""aggregate(sequence(1, size({tokens})), cast(array() as array<int>), (acc, k) ->
        CASE WHEN size(acc) < size({aligned}) AND get({aligned}, size(acc)) = get({tokens}, k - 1) THEN concat(acc, array(k - 1)) ELSE acc END)"""
    return rows.withColumn(name, F.when(F.size(tokens) > 0, F.expr(fold)).otherwise(F.expr("cast(array() as array<int>)")))

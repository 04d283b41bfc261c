import json

import pytest
from pyspark.sql import functions as F

from weftline.operators import detectors as D
from weftline.operators import rows as R
from weftline.operators import words as W


@pytest.fixture()
def tables(spark):
    words = spark.createDataFrame([("a", 0, "um", 0, 100), ("a", 1, "go", 1000, 1100), ("a", 2, "go", 1200, 1300)], "seg_id string, i int, w string, s long, e long")
    islands = spark.createDataFrame([("a", 2000, 2400)], "seg_id string, s long, e long")
    features = spark.createDataFrame([(f"s{i}", "p", 100.0 + i, float(i), 0.1 if i == 3 else 0.8, 0.5, i / 25, i / 25) for i in range(25)], "seg_id string, speaker string, f0_mean double, f0_std double, voiced double, rms double, arousal double, valence double")
    frames = spark.createDataFrame([("a", 0, 0.1, 0.02), ("a", 1, 0.6, 0.02), ("b", 0, 0.9, 0.9)], "seg_id string, f long, laughter double, sigh double")
    clips = spark.createDataFrame([("a", 1000), ("b", 100)], "seg_id string, dur_ms long")
    return {"words": words, "islands": islands, "features": features, "frames": frames, "clips": clips}


def test_detectors(spark, tables):
    rows = D.detect(tables).collect()
    by = {}
    for r in rows:
        by.setdefault(r.tag, []).append(r)
    assert by["pauses"][0].position_s == 0.55 and json.loads(by["pauses"][0].evidence) == {"gap_s": 0.9, "after_word": "um", "before_word": "go"}
    assert sorted(map(sorted, (json.loads(r.evidence) for r in by["hesitates"]))) == [["filler", "gap_s"], ["island", "kind"]]
    assert json.loads(by["whispers"][0].evidence) == {"voiced_ratio": 0.1, "rms": 0.5} and json.loads(by["excited"][0].evidence)["weak"] is True
    assert set(json.loads(by["flatly"][0].evidence)) == {"f0_std_st", "pctl_in_speaker"} and len(json.loads(by["cheerfully"][0].evidence)) == 4
    assert len(by["hesitates"]) == 2 and json.loads(by["stammers"][0].evidence)["repeated"] == "go"
    assert [r.seg_id for r in by["whispers"]] == ["s3"] and by["whispers"][0].score == 0.9
    assert {r.seg_id for r in by["flatly"]} == {"s0", "s1", "s2"} and {r.seg_id for r in by["cheerfully"]} == {"s23", "s24"}
    assert "excited" in by and "sorrowful" in by and all(r.position_s is None for r in by["excited"])
    out = [tuple(r)[:5] for r in D.sounds(tables, {"laughs": ["laughter"], "sigh": ["sigh"]}).collect()]
    assert out == [("a", "laughs", 0.6, "sound_events", 0.5)]


def test_registry(spark, tables):
    with pytest.raises(KeyError):
        D.detect(tables, ["nobody"])
    D.register("bad", lambda t: t["words"])
    with pytest.raises(ValueError):
        D.detect(tables, ["bad"])
    del D.REGISTRY["bad"]
    D.register("none", lambda t: D.whispers(t).limit(0))
    assert D.detect(tables, ["none"]).count() == 0
    del D.REGISTRY["none"]


@pytest.mark.parametrize(
    "tag,evidence,want",
    [
        ("pauses", {"gap_s": 0.861}, "0.86s"),
        ("hesitates", {"filler": "um"}, '"um"'),
        ("hesitates", {"island": [1.0, 1.5]}, "0.50s"),
        ("stammers", {"repeated": "go"}, '"go"'),
        ("stammers", {"island_cluster": [[1, 2], [3, 4], [5, 6]]}, "3×"),
        ("calm", {"arousal": 1}, "0.25"),
        ("pauses", None, "0.25"),
    ],
)
def test_chip_labels(spark, tag, evidence, want):
    df = spark.createDataFrame([(tag, 0.25, evidence and json.dumps(evidence))], "tag string, score double, evidence string")
    assert df.select(D.chip_label(F.col("tag"), F.col("score"), F.col("evidence"))).first()[0] == want


def test_matched_tokens_and_failures(spark):
    df = spark.createDataFrame([(["a", "7", "b", "a"], ["a", "b", "a"]), (["a", "b"], ["b"]), (["a"], ["x", "a"]), ([], [])], "tokens array<string>, words array<string>")
    assert [r.matched for r in D.matched_tokens(df).collect()] == [[0, 2, 3], [1], [], []]
    rows = spark.createDataFrame([("a", None), ("b", "bad")], "k string, error string")
    assert R.raise_if_all_failed(rows) == (2, 1)
    with pytest.raises(RuntimeError):
        R.raise_if_all_failed(rows.where("k = 'b'"))
    assert R.raise_if_all_failed(rows.limit(0)) == (0, 0)


def test_laughs_and_reactions_from_the_classes_at_hand(spark):
    frames = spark.createDataFrame([("a", 0, 0.1, 0.02, 0.5), ("a", 1, 0.6, 0.04, 0.1)], "seg_id string, f long, Laughter double, Sigh double, `Chuckle, chortle` double")
    got = {r.tag: (r.score, r.position_s, json.loads(r.evidence)) for r in D.detect({"frames": frames, "clips": spark.createDataFrame([("a", 1000)], "seg_id string, dur_ms long")}, ["laughs", "reactions"]).collect()}
    assert got == {"laughs": (0.6, 0.5, {"class_scores": {"Laughter": 0.6, "Chuckle, chortle": 0.5}}), "sigh": (0.04, 0.5, {"class_scores": {"Sigh": 0.04}})}


def test_clusters_show_their_islands(spark):
    islands = spark.createDataFrame([("a", k * 500, k * 500 + 310) for k in range(4)], "seg_id string, s long, e long")
    words = spark.createDataFrame([], "seg_id string, i int, w string, s long, e long")
    hits = D.beats({"words": words, "islands": islands}).where("tag = 'stammers'").withColumn("label", D.chip_label(F.col("tag"), F.col("score"), F.col("evidence"))).collect()
    assert [(r.label, json.loads(r.evidence)) for r in hits] == [("3×", {"island_cluster": [[0.0, 0.31], [0.5, 0.81], [1.0, 1.31]]})]


def test_chip_titles(spark):
    title = lambda tag, e: spark.createDataFrame([(tag, 0.25, "d", json.dumps(e))], "t string, s double, d string, e string").select(D.chip_title(F.col("t"), F.col("s"), F.col("d"), F.col("e"))).first()[0].split("\n")[2:-1]
    assert title("pauses", {"gap_s": 0.9, "after_word": "a", "before_word": "b"}) == ['0.9s of silence between "a" and "b"']
    assert title("hesitates", {"filler": "um", "gap_s": 0.4}) == ['filler "um" beside a 0.4s gap'] and title("hesitates", {"island": [1.0, 1.5]}) == ["0.50s of speech with no transcript"]
    assert title("calm", {"arousal": 0.1, "pctl_a": 0.2, "valence": 0.3, "pctl_v": 0.4}) == ["arousal 0.1 (pctl 0.2) · valence 0.3 (pctl 0.4)"]
    assert title("flatly", {"f0_std_st": 1.5, "pctl_in_speaker": 0.05}) == ["pitch variability 1.5 semitones (speaker pctl 0.05)"] and title("laughs", {}) == []


def test_bridging_minds_other_voices(spark):
    groups = spark.createDataFrame([("a", 0, 500), ("a", 1500, 1800), ("a", 2500, 4000), ("a", 7000, 7100)], "seg_id string, s long, e long")
    none = spark.createDataFrame([], "seg_id string, s long, e long")
    got = lambda **kw: sorted((r.k, r.s, r.e) for r in W.bridge_groups(groups, ["seg_id"], **kw).collect())
    assert got() == got(forbidden=none, others=none) == [(0, 0, 1800), (1, 2500, 4000), (2, 7000, 7100)]
    assert got(others=spark.createDataFrame([("a", 500, 1101)], "seg_id string, s long, e long")) == [(0, 0, 500), (1, 1500, 4000), (2, 7000, 7100)]
    assert got(forbidden=spark.createDataFrame([("a", 600, 650)], "seg_id string, s long, e long")) == [(0, 0, 500), (1, 1500, 4000), (2, 7000, 7100)]

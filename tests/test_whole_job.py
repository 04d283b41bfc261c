"""Queries that have to do the whole job, on small tables of their own."""

import os
from datetime import datetime

import pytest

from tests.compare import DATA
from weftline.operators import detectors as D
from weftline.operators import words as W
from weftline.plans import core, views as V, word_queries as Q

data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def test_union_counts_every_detector(spark, tmp_path):
    rows = [(str(i), "s", "v", "calm", 0.5, d, None, None, datetime(2026, 1, 1)) for i, d in enumerate(["beats", "derived", "reactions", "whispers", "later", None])]
    schema = "cand_id string, seg_id string, video_id string, tag string, score double, detector string, position_s double, evidence string, written_at timestamp"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/candidates.parquet")
    out = core.QUERIES["candidate_union"](spark, str(tmp_path)).collect()
    assert sorted((r.detector_name, r.n) for r in out) == [(d, 1) for d in sorted(["beats", "derived", "reactions", "whispers", "later", "(none)"])]


def test_percentiles_stay_within_a_recording(spark):
    """Two recordings whose SPEAKER_00 are not the same person: v has 25 clips, all values of the 19 clips of w are lower."""
    row = lambda v, i, x: (f"{v}{i}", v, "SPEAKER_00", 100 + x, x, 0.1 if i == 10 else 0.8, 1 + x, x, x)
    rows = [row("v", i, 50.0 + i) for i in range(25)] + [row("w", i, i / 25) for i in range(19)]
    f = spark.createDataFrame(rows, "seg_id string, video_id string, speaker string, f0_mean double, f0_std double, voiced double, rms double, arousal double, valence double")
    hits = {}
    for r in D.detect({"features": f}, ["tones", "states", "whispers"]).collect():
        hits.setdefault(r.tag, set()).add(r.seg_id)
    assert hits["flatly"] == {"v0", "v1", "v2"} and hits["cheerfully"] == {"v23", "v24"}
    assert hits["excited"] == {f"v{i}" for i in range(20, 25)} and hits["sorrowful"] == {f"v{i}" for i in range(8)}
    assert hits["whispers"] == {"v10", "w10"}


def lanes_and_turns(spark):
    """Two chunks of p that follow each other closely, and q who speaks in the middle of the first."""
    tokens = ["aaaaa"] * 30
    lanes = spark.createDataFrame([("v", "p", "p0", 0, tokens), ("v", "p", "p1", 13_900, tokens), ("v", "q", "q0", 3000, ["aaaaa"])], "video_id string, speaker string, chunk_id string, start long, tokens array<string>")
    turns = spark.createDataFrame([("v", "p", 0, 30_000), ("v", "q", 3000, 3600), ("w", "q", 0, 30_000)], "video_id string, speaker string, s long, e long")
    return lanes, turns


def test_chunks_know_other_voices_and_neighbours(spark):
    lanes, turns = lanes_and_turns(spark)
    c = {r.chunk_id: r for r in Q.cut_chunks(lanes, turns).collect()}
    pairs = lambda x: [(y.s, y.e) for y in x or []]
    assert pairs(c["p0"].others) == [(3000, 3600)] and pairs(c["p0"].forbidden) == [(2850, 3750)] and pairs(c["p1"].others) == []
    assert pairs(c["q0"].others) == [(0, 30_000)]
    ends, starts = {k: [w.e for w in c[k].words] for k in c}, {k: [w.s for w in c[k].words] for k in c}
    assert c["p0"].prev_end is None and c["p1"].prev_end == max(e for e in ends["p0"] if e < starts["p1"][0])
    assert c["p1"].next_start is None and c["p0"].next_start == min(s for s in starts["p1"] if s > ends["p0"][-1])
    assert c["q0"].prev_end is None and c["q0"].next_start is None
    out = [r.asDict() for r in W.cut_clips(Q.cut_chunks(lanes, turns)).where("speaker = 'p'").collect()]
    alone = W.cut_clips(Q.cut_chunks(lanes, turns.where("speaker = 'p'"))).where("speaker = 'p'").collect()
    inside = lambda r: r["s"] < 3600 and 3000 < r["e"]
    assert out and any(map(inside, alone)) and not any(map(inside, out))


@data
def test_cut_query_sees_the_whole_recording(spark):
    """The query's chunks against a plain reading of the same tables, with every region and word of the recording."""
    lanes = spark.createDataFrame(
        [(r.video_id, r.speaker, r.chunk_id, int(r.start * 1000 + 0.5), r.text.split()) for r in V.table(spark, DATA, "lane_transcripts").where("text IS NOT NULL AND `start` IS NOT NULL AND speaker IS NOT NULL").dropDuplicates(["video_id", "chunk_id"]).collect()],
        "video_id string, speaker string, chunk_id string, start long, tokens array<string>",
    )
    said = V.turns(spark, DATA)
    voices, mine = {}, {}
    for r in said.collect():
        voices.setdefault(r.video_id, []).append((r.speaker, r.s, r.e))
    rows = Q.cut_chunks(lanes, said).collect()
    for r in rows:
        mine.setdefault((r.video_id, r.speaker), []).extend((w.s, w.e) for w in r.words or [])
    assert len(rows) == lanes.count() and any(r.islands for r in rows) and any(r.forbidden for r in rows)
    for r in rows:
        if r.words:
            a, b, near = min(w.s for w in r.words), max(w.e for w in r.words), mine[r.video_id, r.speaker]
            assert r.prev_end == max((e for _, e in near if e < a), default=None) and r.next_start == min((s for s, _ in near if s > b), default=None)
            others = [(s, e) for who, s, e in voices.get(r.video_id, []) if who != r.speaker and s - 150 <= b and a <= e + 150]
            assert sorted((x.s, x.e) for x in r.others or []) == sorted(others)
    clips = core.QUERIES["word_cut_segments"](spark, DATA).collect()
    assert {"clean"} < {c.status for c in clips} and any(c.aligned_frac < 1 for c in clips)

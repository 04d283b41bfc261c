import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import rows as R
from weftline.operators import signals as S
from weftline.operators import waveforms as V


def tone(seconds, level=0.5, rate=V.RATE):
    t = np.arange(int(seconds * rate)) / rate
    return (level * np.sin(2 * np.pi * 200 * t)).astype(np.float32)


def quiet(seconds):
    return np.zeros(int(seconds * V.RATE), np.float32)


def test_edges():
    x = np.concatenate([quiet(1), tone(2), quiet(1)])
    assert V.speech_edges(x, 0.0, 4.0) == pytest.approx((0.92, 3.08))
    assert V.speech_edges(x, 0.0, 0.9) is None
    assert V.speech_edges(quiet(3), 0.0, 3.0) is None
    assert V.speech_edges(np.concatenate([quiet(2), tone(0.3), quiet(2)]), 0.0, 4.3) is None


def test_splits_at_the_quietest_frame_outside_zones():
    x = np.concatenate([tone(12), quiet(0.1), tone(6), tone(0.1, 0.1), tone(12)])
    first = V.quiet_splits(x, 0.0, 30.2, [])
    assert first[0] == (0.0, pytest.approx(12.0, abs=0.02)) and all(b - a <= 20 for a, b in first) and first[-1][1] == 30.2
    other = V.quiet_splits(x, 0.0, 30.2, [(11.9, 12.2)])
    assert other[0][1] == pytest.approx(18.1, abs=0.1)
    assert V.quiet_splits(x, 0.0, 30.2, [(0.0, 40.0)]) == [(0.0, 30.2)]
    assert V.quiet_splits(x, 0.0, 5.0, []) == [(0.0, 5.0)]


def test_mask_paste_and_join():
    x = np.ones(V.RATE, np.float32)
    m = V.masked(x, [(0.25, 0.5)])
    assert m[: int(0.23 * V.RATE)].sum() == 0 and (m[V.RATE // 4 : V.RATE // 2] == 1).all() and 0 < m[int(0.24 * V.RATE)] < 1 and 0 < m[int(0.51 * V.RATE)] < 1 and m[int(0.52 * V.RATE) :].sum() == 0
    two = V.masked(x, [(0.25, 0.5), (0.51, 0.6)])
    assert (two[V.RATE // 4 : int(0.6 * V.RATE)] >= 0.74).all()
    p = V.pasted(np.zeros(V.RATE), x, 1000, 9000)
    assert p[999] == 0 and p[5000] == 1 and 0 < p[1100] < 1 and p[9000] == 0
    assert V.pasted(x, x[:0], 0, 10).sum() == len(x)
    assert V.joined_spans(x, [(0.0, 0.2), (0.5, 0.6)]) is None
    assert len(V.joined_spans(x, [(0.0, 0.4), (0.5, 0.8)])) == pytest.approx(0.7 * V.RATE, abs=2)
    assert len(V.joined_spans(np.ones(V.RATE * 12), [(0.0, 12.0)])) == 10 * V.RATE
    assert V.joined_spans(x, []) is None


def test_columns(spark):
    x = np.concatenate([quiet(0.5), tone(1.5), quiet(0.5)]).tolist()
    df = spark.createDataFrame([(1, x, 0.0, 2.5), (2, None, 0.0, 1.0), (3, x, None, 1.0), (4, [], 0.0, 1.0)], "id int, x array<float>, s double, e double")
    spans = F.lit(None).cast("array<struct<start: double, end: double>>")
    out = {r.id: r for r in df.select("id", V.trim_column(F.col("x"), F.col("s"), F.col("e")).alias("t"), V.mask_column(F.col("x"), spans).alias("m")).collect()}
    assert out[1].t.start == pytest.approx(0.42) and out[2].t is None and out[3].t is None and out[4].t is None
    assert sum(out[1].m) == 0 and out[2].m is None and out[4].m == []
    cut = df.where("id IN (1, 2)").select("id", V.split_column(F.col("x"), F.col("s"), F.col("e"), spans).alias("p")).collect()
    assert {r.id: r.p and [tuple(y) for y in r.p] for r in cut} == {1: [(0.0, 2.5)], 2: None}


def test_prosody(spark):
    frames = spark.createDataFrame([("a", i, 100.0 * (1 + i % 2), i != 3, 0.5, i < 4) for i in range(6)] + [("b", 0, None, False, 0.1, False)], "k string, f int, f0 double, voiced boolean, rms double, active boolean")
    clips = spark.createDataFrame([("a", 6, 2.0), ("b", 0, 1.0)], "k string, n_words int, dur double")
    out = {r.k: r for r in S.prosody(frames, ["k"], clips).collect()}
    assert out["a"].f0_mean == 140.0 and out["a"].f0_std_st == pytest.approx(5.879, abs=1e-3) and out["a"].voiced_ratio == 0.75 and out["a"].rate_wps == 3.0
    assert out["b"].f0_mean is None and out["b"].voiced_ratio == 0.0 and out["b"].rate_wps is None


def test_lookups(spark):
    first = spark.createDataFrame([("a", "x", None), ("b", "", "bad"), ("c", "", "bad")], "k string, t string, error string")
    second = spark.createDataFrame([("b", "y", None), ("c", "z", "bad"), ("a", "q", None)], "k string, t string, error string")
    assert sorted(map(tuple, R.retried(first, second, "k", "t").collect()), key=str) == [("a", "x", None), ("b", "y", None), ("c", "", "bad")]
    v = spark.createDataFrame([(0.0,), (None,), (2.0,)], "v double").select(R.or_default(F.col("v"), 9.0).alias("a"), R.or_default(F.col("v"), 9.0, True).alias("b"))
    assert [tuple(r) for r in v.collect()] == [(0.0, 9.0), (9.0, 9.0), (2.0, 2.0)]
    names = spark.createDataFrame([("clean", "lane"), ("SPEAKER_00", "track"), ("original", "lane"), (".tmp", "lane"), ("clean", "track")], "n string, k string")
    assert [r.n for r in R.source_order(names, "n", "k", ["original", "denoised"]).orderBy("place").collect()] == ["original", "clean", "SPEAKER_00"]

import random

import pytest

from weftline.operators import periods

IV = "video_id string, speaker string, s long, e long"
K = ["video_id", "speaker"]


def brute(rows):
    out = {}
    for v, p, s, e in rows:
        out.setdefault((v, p), []).append((s, e))
    result = {}
    for k, iv in out.items():
        merged = []
        for s, e in sorted(iv):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        result[k] = merged
    return result


@pytest.mark.parametrize("chunk", [7, 1000, 60_000])
def test_against_merging(spark, chunk):
    rng = random.Random(chunk)
    rows = []
    for _ in range(600):
        s = rng.randrange(-50, 3000)
        rows.append((rng.choice(["hot", "hot", "b", "c"]), rng.choice("xy"), s, s + rng.choice([1, 2, 5, 30])))
    want = brute(rows)
    df = spark.createDataFrame(rows + rows[:50], IV)
    got = sorted(map(tuple, periods.periods(df, K, chunk).collect()))
    assert got == sorted((*k, *p) for k, ps in want.items() for p in ps)
    gaps = sorted(map(tuple, periods.gaps(df, K, chunk).collect()))
    assert gaps == sorted((*k, a[1], b[0]) for k, ps in want.items() for a, b in zip(ps, ps[1:]))


def test_touching_nested_single_and_empty(spark):
    rows = [("a", "x", 0, 10), ("a", "x", 10, 12), ("a", "x", 2, 5), ("a", "x", 20, 30), ("b", "x", 1, 2)]
    df = spark.createDataFrame(rows, IV)
    assert [tuple(r) for r in periods.gaps(df, K).collect()] == [("a", "x", 12, 20)]
    assert sorted(map(tuple, periods.periods(df, K).collect())) == [("a", "x", 0, 12), ("a", "x", 20, 30), ("b", "x", 1, 2)]
    assert periods.gaps(df.limit(0), K).count() == periods.periods(df.limit(0), K).count() == 0


def test_dirty_bounds_and_rows_without_a_speaker(spark):
    span = "array<struct<start: double, end: double>>"
    nan, inf = float("nan"), float("inf")
    speakers = spark.createDataFrame(
        [("v", "p", [(0.0, 1.0), (2.0, 3.0), (None, 9.0), (5.0, None), (7.0, 7.0), (8.0, 6.0), (nan, 4.0), (1.0, inf), (2.9996, 2.9999)], None, 1), ("v", None, [(0.0, 1.0), (5.0, 6.0)], [], 2), ("v", "", [(0.0, 1.0), (5.0, 6.0)], [], 2), ("v", "p", [(4.0, 5.0)], [(0.0, 1.0), (1.5, 2.0)], 3)],
        f"video_id string, speaker string, turns {span}, exclusive_turns {span}, src int",
    )
    segments = spark.createDataFrame([("v", "p", 0.0, 0.0005), ("v", "p", 0.002, 0.003), ("v", None, 0.0, 1.0)], "video_id string, speaker string, start double, end double")
    got = sorted(map(tuple, periods.speech_gaps(speakers, segments).collect()))
    assert got == [("v", "p", "exclusive_turns", 1000, 1500), ("v", "p", "segments", 1, 2), ("v", "p", "turns", 1000, 2000), ("v", "p", "turns", 3000, 4000)]

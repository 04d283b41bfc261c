import random

import numpy as np
from pyspark.sql import functions as F

from weftline.llm import repetition


def arrays(texts):
    word = np.array([w for t in texts for w in t], np.int64)
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    ends = np.cumsum([len(t) for t in texts])
    return word, doc, np.repeat(ends, [len(t) for t in texts])


def test_suffix_array_and_lcp_against_sorting():
    rng = random.Random(2)
    for letters in (1, 2, 3, 20):
        texts = [[rng.randrange(letters) for _ in range(rng.randrange(1, 60))] for _ in range(12)]
        word, doc, end = arrays(texts)
        order, lcp, _ = repetition.suffix_array(word, doc, end)
        want = sorted(range(len(word)), key=lambda i: (doc[i], list(word[i : end[i]])))
        assert order.tolist() == want
        for k in range(1, len(order)):
            a, b = order[k - 1], order[k]
            n = 0
            if doc[a] == doc[b]:
                while a + n < end[a] and b + n < end[b] and word[a + n] == word[b + n]:
                    n += 1
            assert lcp[k] == n


def brute_covered(t, m=3):
    out = [False] * len(t)
    for i in range(len(t)):
        for j in range(i):
            n = 0
            while i + n < len(t) and t[i + n] == t[j + n]:
                n += 1
            if n >= m:
                out[i : i + n] = [True] * n
        if i and t[i] == t[i - 1]:
            out[i] = True
        if i > 1 and i + 1 < len(t) and t[i - 2 : i] == t[i : i + 2]:
            out[i] = out[i + 1] = True
    return out


def test_covered_words_against_brute_force():
    rng = random.Random(4)
    for letters in (2, 3, 6):
        texts = [[rng.randrange(letters) for _ in range(rng.randrange(1, 40))] for _ in range(20)]
        word, doc, end = arrays(texts)
        covered, _ = repetition.repeated_words(word, doc, end)
        assert covered.tolist() == [x for t in texts for x in brute_covered(t)]


def shares(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").withColumn("repeated_share", F.lit("clash")).withColumn("_w", F.lit(7))
    return [(round(r.repeated_share, 3), r.longest_repeat) for r in repetition.repetition(df).orderBy("id").collect() if r["_w"] == 7]


def test_cases(spark):
    got = shares(
        spark,
        [
            "one two three four. ONE, two  three\nfour!",
            "ha ha ha ha",
            "tick tock tick tock",
            "the dog and the cat saw the bird",
            "hahahahahaha",
            "1000000000",
            None,
            "",
            " ... !!! ",
            "again",
            "नहीं नहीं नहीं नहीं",
            "we like tea, they like tea",
        ],
    )
    assert [g[0] for g in got] == [0.5, 0.75, 0.5, 0.0, 0.833, 0.0, 0.0, 0.0, 0.0, 0.0, 0.75, 0.0]
    assert got[0][1] == 4 and got[6][1] == 0


def test_zero_width_characters_do_not_part_words(spark):
    assert shares(spark, ["one two​ th﻿ree one two three"])[0][0] == 0.5


def test_very_long_texts_and_empty_table(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    got = shares(spark, [long, long + " " + long, "z" * 100_000])
    assert got[0] == (0.0, 0) and got[1] == (0.5, 60_000) and got[2][0] > 0.999
    assert repetition.repetition(spark.createDataFrame([], "text string")).count() == 0


def test_found_once_from_repeated_rows(spark):
    t = spark.createDataFrame([("s1", "v", "a b c a b c a b c"), ("s1", "v", "a b c a b c a b c"), ("s2", "v", "a b c")], "seg_id string, video_id string, text string")
    lane = spark.createDataFrame([("c1", "v", "no no no no"), (None, None, None)], "chunk_id string, video_id string, text string")
    got = sorted(map(tuple, repetition.repetitive_texts(t, lane).collect()))
    assert got == [("lane_transcripts", "v", "c1"), ("transcripts", "v", "s1")]


def brute_runs(t):
    out = [False] * len(t)
    for p in range(1, len(t) // 3 + 1):
        for i in range(len(t) - 3 * p + 1):
            if t[i : i + 2 * p] == t[i + p : i + 3 * p]:
                out[i + p : i + 3 * p] = [True] * (2 * p)
    return out


def test_runs_against_brute_force():
    rng = random.Random(7)
    for letters in (1, 2, 3):
        texts = [[rng.randrange(letters) for _ in range(rng.randrange(1, 50))] for _ in range(30)] + [[0, 1, 2, 1, 0] * 4 + [9], [5, 6] * 3, list(range(30)) * 3]
        assert repetition.runs(*arrays(texts)).tolist() == [x for t in texts for x in brute_runs(t)]


def test_repetition_within_words_of_any_length_and_script(spark):
    unit = "".join(chr(97 + i * 7 % 26) for i in range(26)) + "zyxwv"
    chinese = "我们今天讨论的是城市交通问题"
    got = [s for s, _ in shares(spark, ["aaaa", "hmmm", unit * 4, unit * 2, chinese * 5, chinese, "1000000 121212", "x" * 30 + "1" + "x" * 30, "今天天气很好 今天我们走吧", "哈哈哈哈"])]
    assert got == [0.75, 0.5, 0.75, 0.0, 0.8, 0.0, 0.0, round(58 / 61, 3), 0.0, 0.75]


def test_limit_of_the_longest_repeat(spark):
    words = " ".join(f"w{i}" for i in range(100))
    t = spark.createDataFrame([("s1", "v", words + " one two three four " + "x y z " + "one two three four"), ("s2", "v", words)], "seg_id string, video_id string, text string")
    lane = spark.createDataFrame([], "chunk_id string, video_id string, text string")
    assert [r.rec_id for r in repetition.repetitive_texts(t, lane, longest=4).collect()] == ["s1"]
    assert repetition.repetitive_texts(t, lane, longest=5).count() == 0

import pytest
from pyspark.sql import functions as F

from weftline.operators import export as X
from weftline.operators import percentiles as P
from weftline.operators import rows as R
from weftline.operators import signals as S
from weftline.operators import words as W

WORDS = "seg_id string, i int, w string, s long, e long"
ISL = "seg_id string, s long, e long"
K = ["seg_id"]


def got(d):
    return sorted(map(tuple, d.collect()))


def test_gap_classes(spark):
    w = spark.createDataFrame([("a", 0, "x", 0, 100), ("a", 1, "y", 599, 700), ("a", 2, "z", 1200, 1300), ("a", 3, "z", 2799, 2900), ("a", 4, "q", 4400, 4500)], WORDS)
    assert [(r[1], r[3]) for r in got(W.pauses(w, K))] == [("pauses", 950.0), ("pauses", 2049.5), ("silence", 3650.0)]
    over = spark.createDataFrame([("a", 900, 1000)], ISL)
    assert [r[2] for r in got(W.silent_pauses(w, over, K))] == [2049.5, 3650.0]
    assert got(W.stammers(w, K)) == []


def test_beats(spark):
    w = spark.createDataFrame([("a", 0, "Um,", 0, 100), ("a", 1, "go", 400, 500), ("a", 2, "Go!", 700, 800), ("b", 0, "um", 0, 10)], WORDS)
    isl = spark.createDataFrame([("a", 0, 300), ("a", 500, 800), ("a", 900, 1200), ("a", 5000, 7000)], ISL)
    assert got(W.stammers(w, K)) == [("a", "go", 400, 200)]
    h = got(W.hesitations(w, isl, K))
    assert ("a", "filler", 0.8, 0.0) in h and len(h) == 4
    assert got(W.island_clusters(isl, K)) == [("a", 0, 1200)]
    assert W.pauses(w.limit(0), K).count() == 0


def test_status_and_edges(spark):
    w = spark.createDataFrame([("a", 0, "x", 10, 100), ("b", 0, "x", 20, 100), ("b", 1, "42", 200, 980), ("c", 0, "x", 100, 200)], WORDS)
    isl = spark.createDataFrame([("b", 100, 200), ("c", 300, 2000)], ISL)
    assert {r.seg_id: r.status for r in W.alignment_status(w, isl, K).collect()} == {"a": "clean", "b": "digits_uncertain", "c": "major_gap"}
    dur = w.withColumn("dur", F.lit(990))
    assert {r.seg_id: r.clipped for r in W.clipped_edges(dur, K, "dur").collect()} == {"a": ["start"], "b": ["end"], "c": []}
    own = W.token_owner(spark.createDataFrame([("a", 0, "1"), ("a", 1, "x"), ("a", 2, "2"), ("a", 3, "y"), ("z", 0, "9")], "seg_id string, i int, w string"), K, F.col("w").rlike("[a-z]"))
    assert got(own.select("seg_id", "i", "owner")) == [("a", 0, 1), ("a", 1, 1), ("a", 2, 1), ("a", 3, 3), ("z", 0, None)]


def chunk(words, tokens=None, islands=(), forbidden=(), others=(), prev=None, nxt=None, cid="c0", start=0):
    tokens = tokens or [f"t{i}" for i in range(max(w[0] for w in words) + 1)]
    return ("v", "p", cid, start, tokens, words, list(islands), list(forbidden), list(others), prev, nxt)


def cut(spark, *chunks, **kw):
    return [r.asDict(True) for r in W.cut_clips(spark.createDataFrame(list(chunks), W.CHUNK), **kw).orderBy("n").collect()]


def test_cut_groups_bridges_and_pads(spark):
    # two groups 700 ms apart, both long enough: two clips; edges are padded but keep clear of the neighbours
    out = cut(spark, chunk([(0, 1000, 1500), (1, 1550, 2200), (2, 2900, 3500), (3, 3600, 4100)]))
    assert [(c["s"], c["e"], c["text"]) for c in out] == [(850, 2400, "t0 t1"), (2750, 4300, "t2 t3")]
    # a short group is bridged, unless a foreign voice or a forbidden region lies between
    short = [(0, 1000, 2200), (1, 3000, 3500)]
    assert [c["text"] for c in cut(spark, chunk(short))] == ["t0 t1"]
    assert [c["text"] for c in cut(spark, chunk(short, others=[(2200, 2900)]))] == ["t0"]
    assert [c["text"] for c in cut(spark, chunk(short, forbidden=[(2400, 2500)]))] == ["t0"]


def test_cut_splits_at_the_later_of_the_largest_gaps(spark):
    words, t = [], 0
    for i in range(20):
        words.append((i, t, t + 1150))
        t += 1150 + (300 if i in (8, 12) else 100)
    out = cut(spark, chunk(words), edge=0, clipped=0)
    assert out[0]["text"].split()[-1] == "t12" and out[1]["text"].split()[0] == "t13"


def test_cut_gives_up_words_without_a_clean_edge(spark):
    words = [(0, 0, 1500), (1, 1560, 1700), (2, 2000, 3500)]
    out = cut(spark, chunk(words, forbidden=[(1400, 1550)]))
    assert [c["text"] for c in out] == ["t2"]
    assert cut(spark, chunk([(0, 1000, 1900)])) == []
    assert cut(spark, chunk([(0, 1000, 2100)], prev=950)) == []


def test_cut_glitch_tail_and_tokens_between(spark):
    # a word of more than 2 s can't be used; digits without alignment stay in the text and extend the end over their island
    out = cut(spark, chunk([(0, 1000, 2200), (2, 2300, 2900)], tokens=["a", "87,000", "b", "99"], islands=[(3000, 3600)]))
    assert out[0]["text"] == "a 87,000 b 99" and out[0]["e"] == 3700 and out[0]["status"] == "digits_uncertain"
    assert cut(spark, chunk([(0, 1000, 3500)])) == []


def test_cut_clips_of_a_speaker_never_overlap(spark):
    import random

    rng = random.Random(4)
    chunks = []
    for k in range(6):
        t, words = k * 60_000, []
        for i in range(60):
            t += rng.choice([20, 60, 130, 280, 700, 2500])
            d = rng.choice([80, 200, 400, 2300])
            words.append((i, t, t + d))
            t += d
        chunks.append(chunk(words, cid=f"c{k}", start=k * 60_000, forbidden=[(k * 60_000 + 3000, k * 60_000 + 3200)]))
    out = cut(spark, *chunks)
    assert len(out) > 10 and [c["n"] for c in out] == list(range(len(out)))
    for a, b in zip(out, out[1:]):
        assert b["s"] >= a["e"] + 10
    assert all(c["e"] - c["s"] >= 1000 and c["words"] and c["words"][0]["s"] >= 0 for c in out)


def test_cut_nulls(spark):
    odd = [("v", "p", "c", 0, None, [(0, 0, 1500)], None, None, None, None, None), ("v", "p", "d", 0, ["a"], None, [], [], [], None, None), (None, None, None, None, ["a"], [(0, 0, 1500)], None, None, None, None, None)]
    assert len(cut(spark, *odd)) == 1
    assert W.cut_clips(spark.createDataFrame([], W.CHUNK)).count() == 0
    with pytest.raises(ValueError):
        W.cut_clips(spark.createDataFrame([], W.CHUNK), nonsense=1)


def test_gates_and_thresholds(spark):
    df = spark.createDataFrame([("", True, True, None), ("t", None, False, ["start"]), ("t", False, False, [])], "text string, sep boolean, ok boolean, clipped array<string>")
    flags = X.clip_flags(F.col("text"), F.lit(0.2), F.col("ok"), F.col("clipped"), F.col("sep"), F.lit(None).cast("string"))
    both = df.select(X.gate(flags).alias("g"), X.listed_reason(flags, F.lit(False)).alias("r")).collect()
    assert [(r.g, r.r) for r in both] == [("separated", "no text"), ("clipped", "clipped edge word"), (None, "export gate")]
    c = spark.createDataFrame([("laughs", 0.2), ("laughs", 0.19), ("silence", None), ("sigh", None), (None, 0.1)], "tag string, score double")
    assert X.passing(c).count() == 3


def test_silences_and_rendering(spark):
    c = spark.createDataFrame([("a", "pauses", 0.5, 1000), ("a", "pauses", 0.5, 1000), ("a", "pauses", 0.3, 9000), ("a", "calm", 0.9, None), ("a", "laughs", None, 10)], "seg_id string, tag string, score double, position_ms long")
    gaps = spark.createDataFrame([("a", "pauses", 0.4, 900.0), ("a", "silence", 1.0, 1100.0), ("a", "silence", 1.0, 5000.0)], "seg_id string, tag string, score double, mid double")
    out = sorted((r.tag, r.position_ms, r.derived) for r in X.with_silences(c, gaps).collect() if r.tag != "calm")
    assert out == [("laughs", 10.0, False), ("pauses", 9000.0, False), ("silence", 1000.0, False), ("silence", 1000.0, False), ("silence", 5000.0, True)]
    texts = spark.createDataFrame([("a", "a b  c"), ("n", "x y"), ("e", "")], "seg_id string, text string")
    words = spark.createDataFrame([("a", 0, 0), ("a", 1, 1000), ("a", 2, 2000)], "seg_id string, i int, s long")
    tags = spark.createDataFrame([("a", "pauses", 0.5, 500), ("a", "sigh", 0.5, 9000), ("a", "calm", 0.7, 700), ("a", "laughs", 0.9, None), ("n", "sigh", 0.5, 1), ("zz", "sigh", 0.5, 1)], "seg_id string, tag string, score double, position_ms long")
    lines = {r.seg_id: r for r in X.render(texts, words, tags).collect()}
    assert {k: r.tagged for k, r in lines.items()} == {"a": "[laughs] [calm] a [pauses] b c [sigh]", "n": "[sigh] x y"}
    assert lines["a"].tags == ["calm", "laughs", "pauses", "sigh"] and lines["n"].tags == ["sigh"]


def test_matrix(spark):
    df = spark.createDataFrame([("s", ["x", "x", "y"]), ("s", []), ("t", None)], "speaker string, tags array<string>")
    assert got(X.matrix(df)) == [("s", "_neutral", 1), ("s", "_rows", 2), ("s", "x", 1), ("s", "y", 1), ("t", "_neutral", 1), ("t", "_rows", 1)]


def test_percentiles(spark):
    rows = [("s", float(x)) for x in (1, 2, 2, 4, 5, 6, 7, 8, 9, 10)] + [("s", None), ("s", float("nan"))] + [("few", float(x)) for x in range(9)]
    out = P.strict_percentile(spark.createDataFrame(rows, "speaker string, x double"), ["speaker"], "x", "p", width=2.0).collect()
    s = sorted((r.x, r.p) for r in out if r.speaker == "s" and r.p is not None)
    assert len(out) == len(rows) and s[1:4] == [(2.0, 0.1), (2.0, 0.1), (4.0, 0.3)] and s[-1] == (10.0, 0.9)
    assert {r.p for r in out if r.speaker == "few"} == {0.5}


def test_signals(spark):
    s = spark.createDataFrame([("c", i, float(i % 5)) for i in range(23)], "clip string, i long, x double")
    assert S.frame_rms(s, ["clip"], 5).count() == 4
    assert len(got(S.peaks(s, ["clip"], 10))) == 11
    sc = spark.createDataFrame([("c", 0, 0.1, 0.9), ("c", 1, 0.9, 0.2), ("d", 0, 0.01, 0.0)], "clip string, f long, a double, b double")
    assert got(S.event_peak(sc, ["clip"], ["a", "b"], 0.05)) == [("c", 0.9, 0, 0.9, 0.9)]
    e = spark.createDataFrame([(1, "p", [3.0, 0.0]), (2, "p", [0.0, 2.0]), (3, "p", [0.0, 0.0]), (4, "q", [1.0, float("nan")])], "id int, spk string, v array<double>")
    cen = S.centroids(e, "spk", "v", 2)
    assert [r.centroid for r in cen.collect()][0] == pytest.approx([2**-0.5, 2**-0.5])
    p = {r.id: r for r in S.purity(e, cen, "spk", "v").collect()}
    assert p[1].purity == pytest.approx(2**-0.5) and p[1]["pass"] and p[3].purity is None and p[4].purity is None
    t = spark.createDataFrame([("a", 0, 500), ("a", 600, 700), ("b", 0, 2000)], "k string, s long, e long")
    assert got(S.longest_first(t, ["k"])) == [("a", 0, 500), ("a", 600, 700), ("b", 0, 2000)]


def test_rows(spark):
    df = spark.createDataFrame([("a", i) for i in range(10)], "k string, i int")
    assert [r.i for r in R.systematic_sample(df, ["k"], ["i"], 4).orderBy("i").collect()] == [0, 2, 5, 7]
    assert R.systematic_sample(df, ["k"], ["i"], 40).count() == 10
    both = R.union_all({"b": df, "a": df.withColumn("z", F.lit(1))})
    assert both.where("z IS NULL").select("detector_name").distinct().collect()[0][0] == "b"
    log = spark.createDataFrame([("j", 1, "x"), ("j", 2, "x"), ("j", 3, None), ("j", 4, None), ("j", 5, "x")], "job string, t int, m string")
    assert [r.t for r in R.new_messages(log, "t", "m", ["job"]).orderBy("t").collect()] == [1, 3, 5]
    pick = spark.createDataFrame([("a", "orig"), ("a", "clean"), ("b", "other")], "k string, lane string")
    assert got(R.first_of(pick, ["k"], "lane", ["clean", "orig"])) == [("a", "clean")]

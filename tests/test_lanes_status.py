import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import lanes as L
from weftline.operators import rows as R
from weftline.operators import status as S
from weftline.operators import words as W
from weftline.sources import manifests as M

SPAN = "video_id string, speaker string, s long, e long"
STREAM = "video_id string, speaker string, window long, stream int, similarity double, rms double"


def test_verdicts(spark):
    rows = [("v", "a", 0, 0, 0.4, 0.1), ("v", "a", 0, 1, 0.7, 0.1), ("v", "a", 1, 0, 0.5, 0.1), ("v", "a", 1, 1, 0.5, 0.1), ("v", "a", 2, 0, None, 0.1), ("v", "a", 3, 0, 0.1, 0.001)]
    out = {r.window: (r.stream, r.purity, r["pass"]) for r in L.verdicts(spark.createDataFrame(rows, STREAM), L.KEYS).collect()}
    assert out == {0: (1, 0.7, True), 1: (0, 0.5, False), 2: (0, None, None), 3: (0, 1.0, True)}
    assert L.verdicts(spark.createDataFrame([], STREAM), L.KEYS).count() == 0


def test_clean_lane(spark):
    turns = spark.createDataFrame([("v", "a", 0, 15_000), ("v", "b", 4000, 12_000)], SPAN)
    streams = lambda w: w.withColumns({"stream": F.lit(0), "similarity": F.when(F.col("window") == 0, 0.9).otherwise(0.2), "rms": F.lit(0.1)})
    lane = L.clean_lane(turns, spark.createDataFrame([], "video_id string, s long, e long"), streams)
    got = lambda name: sorted((r.speaker, r.s, r.e) for r in lane[name].collect())
    assert got("suspect") == [("a", 3600, 12_400), ("b", 4000, 12_000)]
    assert got("rescued") == [("a", 3500, 10_000), ("b", 3900, 10_000)]
    assert got("forbidden") == [("a", 3440, 20_000), ("b", 3840, 20_000)]
    clips = spark.createDataFrame([("v", "a", 0, 3500), ("v", "a", 3000, 4000), ("v", "c", 0, 30_000)], SPAN)
    assert sorted((r.speaker, r.e, r.over_len, r.separated_s, r.separated, r.separated_frac) for r in L.levels(clips, lane["rescued"]).collect()) == [
        ("a", 3500, False, 0.0, False, 0.0), ("a", 4000, False, 0.5, True, 0.5), ("c", 30_000, True, 0.0, False, 0.0),
    ]
    assert sorted((r.speaker, r.s, r.e) for r in L.forbidden_masked(turns).collect()) == [("a", 3850, 12_150), ("b", -150, 15_150)]


def test_solo_snippets(spark):
    turns = spark.createDataFrame([("v", "a", 0, 9000), ("v", "b", 9500, 9900), ("v", "b", 8000, 9000)], SPAN)
    assert sorted((r.speaker, r.s, r.e) for r in L.solo_snippets(turns).collect()) == [("a", 0, 5000), ("b", 9500, 9900)]
    emb = spark.createDataFrame([("v", "a", 0, [3.0, 0.0]), ("v", "a", 7, [0.0, 1.0]), ("v", "b", 9500, [0.0, 2.0])], "video_id string, speaker string, s long, embedding array<double>")
    assert {r.speaker: [round(x, 6) for x in r.centroid] for r in L.solo_centroids(emb, turns, 2).collect()} == {"a": [1.0, 0.0], "b": [0.0, 1.0]}


def test_status(spark):
    rows = [("j", "stage", "asr", "running", "x", 0.4), ("j", "stage", "align", "queued", "", 0.0), ("j", "stage", "denoise", "done", "", 1.0), ("j", "stage", "export", "done", "", 1.0), ("j", "detector", "beats", "queued", "", 0.0), ("k", "detector", "tones", "done", None, None)]
    before = spark.createDataFrame(rows, S.SCHEMA)
    after = {(r.job, r.name): (r.status, r.msg) for r in S.recovered(before).collect()}
    assert after == {("j", "asr"): ("error", S.INTERRUPTED), ("j", "align"): ("pending", ""), ("j", "export"): ("done", ""), ("j", "beats"): ("error", S.INTERRUPTED), ("k", "tones"): ("done", None)}
    stages = S.reconciled(S.recovered(before), spark.createDataFrame([("j", "diarize"), ("j", "diarize"), ("x", "asr")], "job string, name string"))
    out = {(r.job, r.name): (r.status, r.msg, r.progress) for r in stages.collect()}
    assert len(out) == 14 and out["j", "diarize"] == ("done", "", 1.0) and out["j", "export"] == ("pending", "", 0.0) and out["j", "asr"] == ("error", S.INTERRUPTED, 0.4) and out["k", "asr"] == ("pending", None, None)
    q = S.queue_summary(before).first()
    assert (q.queue_len, q.running, q.job, q.kind, q.name) == (2, 1, "j", "stage", "asr")
    assert S.queue_summary(before.limit(0)).first().queue_len == 0
    summary = {r.job: (r.done, r.failed, r.next_stage, r.n_rows, r.minutes) for r in S.job_summary(stages, spark.createDataFrame([("j", 90.0), ("j", 30.0)], "video_id string, dur double")).collect()}
    assert summary == {"j": (1, 1, "ingest", 2, 2.0), "k": (0, 0, "ingest", 0, 0.0)}
    log = spark.createDataFrame([("j", "asr", 1, "a", 0.1), ("j", "asr", 2, "b" * 400, 0.98765)], "job string, name string, at int, msg string, progress double")
    assert [(len(r.msg), r.progress) for r in S.log_progress(log).collect()] == [(300, 0.988)]


def test_romanized_and_lane_names(spark):
    df = spark.createDataFrame([("नमस्ते",), ("ज़्यादा",), ("हूँ",), ("Don't",), ("१२",), (None,)], "t string")
    assert [r[0] for r in df.select(T.alignable(F.col("t"))).collect()] == ["namaste", "zyaadaa", "huun", "don't", "", None]
    names = spark.createDataFrame([("sam_speaker_02_clean",), ("SPEAKER_01",), ("original",), ("sam_speaker_00_x",), ("sam_anna_clean",)], "n string")
    assert [tuple(r) for r in names.select(T.lane_owner(F.col("n")), T.clean_owner(F.col("n"))).collect()] == [("SPEAKER_02", "SPEAKER_02"), ("SPEAKER_01", None), (None, None), ("SPEAKER_00", None), (None, None)]


def test_dropped_ordered_and_engines(spark):
    df = spark.createDataFrame([("v", 500), ("v", 1000), ("v", 250), ("w", 2000)], "k string, n long")
    assert sorted(map(tuple, R.short_dropped(df, ["k"], F.col("n")).collect())) == [("v", 1, 2, 0.75), ("w", 1, 0, 0.0)]
    assert sorted((r.k, r.n, r.place) for r in R.in_order(df, ["k"], ["n"], 2).collect()) == [("v", 250, 1), ("v", 500, 2), ("w", 2000, 1)]
    t = spark.createDataFrame([("v", "e1"), ("v", None), ("w", None)], "k string, engine string")
    assert sorted((r.k, r.asr) for r in R.with_engine(t.select("k").distinct(), t, ["k"]).collect()) == [("v", "e1"), ("w", "lane")]
    chunks = spark.createDataFrame([("a", 0), ("b", 1), ("c", 0)], "k string, n_skipped int")
    span = "k string, s long, e long"
    out = W.chunk_status(chunks, spark.createDataFrame([("a", 0, 1000), ("b", 0, 1000)], span), spark.createDataFrame([("a", 0, 250), ("b", 0, 500)], span), ["k"])
    assert sorted(map(tuple, out.collect())) == [("a", 1000, 250, "filler_suspect", 0.75), ("b", 1000, 500, "digits_uncertain", 0.5), ("c", 0, 0, "clean", None)]


def test_documents_sources_and_stages(spark, tmp_path):
    assert [tuple(r) for r in M.read_document(spark, f"{tmp_path}/none.json", "a int, b string").collect()] == [(None, None)]
    M.write_document(spark.createDataFrame([(1, None)], "a int, b string"), f"{tmp_path}/doc.json")
    assert [tuple(r) for r in M.read_document(spark, f"{tmp_path}/doc.json", "a int, b string").collect()] == [(1, None)]
    with pytest.raises(ValueError):
        M.write_document(spark.range(2), f"{tmp_path}/two.json")
    os.makedirs(f"{tmp_path}/media/sub")
    for name in ("a.wav", "b.MP3", "c.txt", "sub/d.wav"):
        open(f"{tmp_path}/media/{name}", "wb").write(b"12345")
    got = [(r.place, os.path.basename(r.source), r.kind) for r in M.expand_sources(spark, ["https://x.example/1", f"{tmp_path}/media", "nothing-there"]).orderBy("place", "source").collect()]
    assert got == [(0, "1", "url"), (1, "a.wav", "file"), (1, "b.MP3", "file"), (2, "nothing-there", "literal")]
    assert M.bytes_freed(spark, f"{tmp_path}/media") == 20
    calls = []
    build = lambda: (calls.append(1), spark.range(3))[1]
    assert [M.run_stage(spark, f"{tmp_path}/stage", build, force).count() for force in (False, False, True)] == [3, 3, 3] and len(calls) == 2


def test_corpus_with_its_clips(spark, tmp_path):
    os.makedirs(f"{tmp_path}/jobs/j/wav")
    open(f"{tmp_path}/jobs/j/wav/s1.wav", "wb").write(b"sound")
    rows = spark.createDataFrame([("s1", "Ann", "wav/s1.wav", "j"), ("s2", "Ann", "wav/none.wav", "j"), ("s3", "Bo", None, "j")], "sample_id string, speaker string, wav string, job string")
    M.write_corpus(rows, f"{tmp_path}/out", jobs=f"{tmp_path}/jobs")
    assert open(f"{tmp_path}/out/clips/Ann/s1.wav", "rb").read() == b"sound" and os.listdir(f"{tmp_path}/out/clips/Ann") == ["s1.wav"]
    lines = [json.loads(x) for d, _, files in os.walk(f"{tmp_path}/out/dataset") for f in files if f.endswith(".json") for x in open(f"{d}/{f}")]
    assert sorted(x["wav"] for x in lines) == ["clips/Ann/s1.wav", "clips/Ann/s2.wav", "clips/Bo/s3.wav"]


def test_calls_are_tried_again(spark, tmp_path):
    folder = str(tmp_path)

    def call(rows: pd.DataFrame) -> pd.DataFrame:
        for k in rows["k"]:
            open(f"{folder}/{k}", "a").write("x")
            if k == "bad" or os.path.getsize(f"{folder}/{k}") < 3 and k == "late":
                raise RuntimeError("no")
        return pd.DataFrame({"k": rows["k"], "text": "ok"})

    df = spark.createDataFrame([("good",), ("late",), ("bad",)], "k string").coalesce(1)
    out = {r.k: (r.text, r.error) for r in M.call_in_batches(df, call, "k string, text string, error string", "k", 1, tries=4, pause=0.01, per_minute=60_000).collect()}
    assert out == {"good": ("ok", None), "late": ("ok", None), "bad": (None, "RuntimeError: no")}
    assert os.path.getsize(f"{folder}/bad") >= 4


def test_numbered_in_stretches_is_the_number_in_all(spark):
    rows = [(k, i * 7 % 100, i) for k in ("a", "b") for i in range(100 if k == "a" else 5)] + [(None, 1, 1), ("a", None, 1)]
    df = spark.createDataFrame(rows, "k string, t int, i int")
    out = R.numbered(df, ["k"], "t", ["t", "i"], 10, "place", "n").collect()
    for k in ("a", "b"):
        mine = sorted((r for r in out if r.k == k), key=lambda r: (r.t, r.i))
        assert [r.place for r in mine] == list(range(len(mine))) and {r.n for r in mine} == {len(mine)} == {100 if k == "a" else 5}
    pick = lambda **kw: sorted((r.k, r.t, r.i) for r in R.systematic_sample(df.where("k IS NOT NULL AND t IS NOT NULL"), ["k"], ["t", "i"], 12, **kw).collect())
    assert pick() == pick(width=10) and len(pick()) == 17


def test_command_line(spark, tmp_path, monkeypatch):
    from weftline.__main__ import main

    monkeypatch.chdir(tmp_path)
    for job, n in (("j1", 2), ("j2", 1)):
        os.makedirs(f"{tmp_path}/jobs/{job}/manifests")
        with open(f"{tmp_path}/jobs/{job}/manifests/dataset.jsonl", "w") as f:
            f.writelines(json.dumps({"sample_id": f"{job}_{i}", "speaker": "Ann", "wav": "w.wav", "dur": 45.0, "tags": ["calm"]}) + "\n" for i in range(n))
    assert main(["collect", f"{tmp_path}/jobs", f"{tmp_path}/out", "--no-copy"], spark) == {"rows": 3, "minutes": 2.3, "speakers": 1}
    lines = [json.loads(x) for d, _, files in os.walk(f"{tmp_path}/out/dataset") for f in files if f.endswith(".json") for x in open(f"{d}/{f}")]
    assert sorted(x["wav"] for x in lines) == ["j1/w.wav", "j1/w.wav", "j2/w.wav"] and os.path.isdir(f"{tmp_path}/out/matrix")
    assert "p5_found" in main(["queries"])
    with pytest.raises(SystemExit):
        main(["query", "nothing", "."])


def test_environment_and_payload(tmp_path, monkeypatch):
    import numpy as np

    from weftline.operators.waveforms import payload, unpacked
    from weftline.runtime import load_env

    (tmp_path / ".env").write_text("# note\nWEFT_A=1\nWEFT_B = 'two'\n\nnothing\n")
    monkeypatch.setenv("WEFT_A", "kept")
    monkeypatch.delenv("WEFT_B", raising=False)
    assert load_env(str(tmp_path / ".env")) == {"WEFT_A": "1", "WEFT_B": "two"} and os.environ["WEFT_A"] == "kept" and os.environ["WEFT_B"] == "two"
    assert load_env(str(tmp_path / "none")) == {}
    monkeypatch.delenv("WEFT_B")
    clips, words = unpacked(payload([np.array([0.5, -0.25]), np.array([1.0])], [["a"], []]))
    assert [c.tolist() for c in clips] == [[0.5, -0.25], [1.0]] and words == [["a"], []]
    assert unpacked(payload([])) == ([], [])


def test_embeddings_windows_and_lines(spark, tmp_path):
    from weftline.operators.intervals import runs
    from weftline.streaming.tables import lines_done, stream_lines

    emb = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [0.0, 0.0]), (3, "b", None), (4, "b", [float("nan"), 1.0])], "id int, who string, embedding array<double>")
    assert [r.id for r in M.write_embeddings(emb, f"{tmp_path}/emb", "who").collect()] == [1]
    frames = spark.createDataFrame([("c", i, i not in (3,)) for i in range(20)], "clip string, f long, on boolean")
    assert sorted((r.first, r.stop) for r in runs(frames, ["clip"], "f", "on").collect()) == [(0, 3), (4, 20)]
    assert sorted((r.first, r.stop) for r in runs(frames, ["clip"], "f", "on", window=10).collect()) == [(0, 3), (4, 10), (10, 20)]
    os.makedirs(f"{tmp_path}/lines")
    schema = "engine string, error string"
    stream = lines_done(stream_lines(spark, f"{tmp_path}/lines", schema), ["engine"], 4)
    query = stream.writeStream.outputMode("complete").format("memory").queryName("lines_so_far").option("checkpointLocation", f"{tmp_path}/state").start()
    try:
        for k, rows in enumerate(([{"engine": "e"}], [{"engine": "e", "error": "x"}, {"engine": "e"}])):
            with open(f"{tmp_path}/lines/.{k}", "w") as f:
                f.writelines(json.dumps(r) + "\n" for r in rows)
            os.rename(f"{tmp_path}/lines/.{k}", f"{tmp_path}/lines/{k}.json")
            query.processAllAvailable()
        assert [tuple(r) for r in spark.table("lines_so_far").collect()] == [("e", 3, 1, 0.75)]
    finally:
        query.stop()
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, w int")
    done = spark.createDataFrame([("a", 1, None), ("b", 1, "bad")], "k string, w int, error string")
    assert sorted(map(tuple, R.to_do(rows, done, ["k", "w"], "error").collect())) == [("a", 2), ("b", 1)]

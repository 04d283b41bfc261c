import json
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftline.sources import manifests as M
from weftline.streaming import tables as S


def put(path, *rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows) + "\n\n")


def test_json_lines(spark, tmp_path):
    assert M.read_jsonl(spark, str(tmp_path / "none.jsonl"), "segments").count() == 0
    put(tmp_path / "t.jsonl", {"seg_id": "a", "text": "नमस्ते", "script": {"chars": 3}}, {"seg_id": "b"})
    rows = {r.seg_id: r for r in M.read_jsonl(spark, str(tmp_path / "t.jsonl"), "transcripts").collect()}
    assert rows["a"].text == "नमस्ते" and rows["a"].script.chars == 3 and rows["b"].text is None
    (tmp_path / "bad.jsonl").write_text('{"seg_id": \n')
    with pytest.raises(Exception):
        M.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "transcripts").collect()
    df = M.read_jsonl(spark, str(tmp_path / "t.jsonl"), "transcripts")
    M.write_jsonl(df, str(tmp_path / "out"))
    assert M.read_jsonl(spark, str(tmp_path / "out"), "transcripts").exceptAll(df).count() == 0


def test_candidates_corpus_and_manifest(spark, tmp_path):
    job = tmp_path / "jobs" / "v1"
    put(job / "manifests" / "candidates_beats.jsonl", {"seg_id": "a", "tag": "pauses", "score": 0.5, "evidence": {"gap_s": 1.5}})
    put(job / "manifests" / "candidates_laughs.jsonl", {"seg_id": "b", "tag": "laughs", "score": 0.2})
    got = {r.detector_name: r for r in M.read_candidates(spark, str(job / "manifests")).collect()}
    assert set(got) == {"beats", "laughs"} and json.loads(got["beats"].evidence) == {"gap_s": 1.5}
    put(job / "manifests" / "dataset.jsonl", {"sample_id": "s1", "speaker": "p", "wav": "segments/p/s1.wav"})
    (tmp_path / "jobs" / "v2" / "manifests").mkdir(parents=True)
    corpus = M.read_corpus(spark, str(tmp_path / "jobs"))
    assert [r.job for r in corpus.collect()] == ["v1"]
    for copied, wav in ((True, "clips/p/s1.wav"), (False, "v1/segments/p/s1.wav")):
        M.write_corpus(corpus, str(tmp_path / "out"), copied)
        assert [r.wav for r in spark.read.json(str(tmp_path / "out" / "dataset")).collect()] == [wav]
    assert M.read_manifest(spark, str(job), "dataset.jsonl", "dataset").count() == 1
    (job / "manifests" / "job.json").write_text('{\n"video_id": "v1"}')
    assert M.read_manifest(spark, str(job), "job.json", "video_id string").first()[0] == "v1"
    for name, error in (("../x.jsonl", ValueError), ("..", ValueError), ("nope.jsonl", FileNotFoundError)):
        with pytest.raises(error):
            M.read_manifest(spark, str(job), name, "dataset")


def test_media_parts_cache_and_batches(spark, tmp_path):
    for n in ("a.wav", "b.MP3", "c.txt"):
        (tmp_path / "m").mkdir(exist_ok=True)
        (tmp_path / "m" / n).write_bytes(b"x" * 5)
    assert sorted(r.path.rsplit("/", 1)[1] for r in M.list_media(spark, str(tmp_path / "m")).collect()) == ["a.wav", "b.MP3"]
    d = spark.createDataFrame([("x", 1), ("y", 2)], "det string, n int")
    M.replace_part(d, str(tmp_path / "p"), "det")
    M.replace_part(spark.createDataFrame([("x", 9)], "det string, n int"), str(tmp_path / "p"), "det")
    assert sorted((r.det, r.n) for r in spark.read.parquet(str(tmp_path / "p")).collect()) == [("x", 9), ("y", 2)]
    seen = []

    def compute(rows):
        seen.append(sorted(r.id for r in rows.collect()))
        return rows.select("id", F.when((F.col("id") == 2) & F.lit(len(seen) == 1), "boom").alias("error"))

    ids = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    M.extend_cache(ids, str(tmp_path / "cache"), "id", compute)
    assert sorted(r.id for r in M.extend_cache(ids, str(tmp_path / "cache"), "id", compute).collect()) == [1, 2, 3]
    assert seen == [[1, 2, 3], [2]]

    def call(few: pd.DataFrame) -> pd.DataFrame:
        if (few["id"] == 13).any():
            raise RuntimeError("bad batch")
        assert len(few) <= 8
        return pd.DataFrame({"id": few["id"], "text": "t"})[few["id"].to_numpy() != 3]

    out = {r.id: r for r in M.call_in_batches(spark.range(20).select(F.col("id").cast("int").alias("id")).coalesce(1), call, "id int, text string, error string", "id").collect()}
    assert len(out) == 20 and out[0].text == "t" and "bad batch" in out[13].error and out[3].error == "no answer"


def test_stream_windows_and_upserts(spark, tmp_path):
    t0 = datetime(2025, 1, 1)
    e = spark.createDataFrame([(i, t0 + timedelta(minutes=10 * i), i % 2, "a", 1.0) for i in range(30)], "event_id int, ts timestamp, user_id int, event_type string, value double")
    (tmp_path / "d").mkdir()
    e.coalesce(1).write.parquet(str(tmp_path / "d" / "events.parquet"))
    stream = S.stream_table(spark, str(tmp_path / "d"), "events")
    w = S.drained(S.event_windows(stream, "ts", ["event_type"], "value"))
    assert sorted(r.n for r in w.collect()) == [6] * 5
    assert S.drained(S.sessions(S.stream_table(spark, str(tmp_path / "d"), "events"), "ts", ["user_id"], "15 minutes")).count() == 30

    src = tmp_path / "rows"
    schema = "k int, v string, written_at timestamp"
    for i, rows in enumerate(([(1, "old", t0), (2, "only", t0)], [(1, "new", t0 + timedelta(1)), (3, "x", t0)], [(1, "late", t0 - timedelta(1))])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(src / f"f{i}"))
        s = spark.readStream.schema(schema).parquet(str(src / "*"))
        S.upsert_latest(s, str(tmp_path / "table"), str(tmp_path / "ck"), ["k"]).awaitTermination()
    assert sorted((r.k, r.v) for r in S.current(spark, str(tmp_path / "table")).collect()) == [(1, "new"), (2, "only"), (3, "x")]

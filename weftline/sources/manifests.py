"""Tables of a job as JSON lines, single documents, and the corpus of all jobs.

Schemas are given, never inferred; inside, tables are Parquet.
"""

from __future__ import annotations

import os
import posixpath
import shutil
import time
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.runtime import settle

_SPAN = "array<struct<start: double, end: double>>"
_SCRIPT = "struct<chars: int, deva_frac: double, latin_frac: double, script_switches: int>"
_WORDS = "array<struct<i: int, w: string, start: double, end: double>>"

# The columns of each table as it is written.
SCHEMAS = {
    "speakers": f"video_id string, speaker string, total_s double, turns {_SPAN}, exclusive_turns {_SPAN}, track_wav string, embedding_ok boolean",
    "lane_transcripts": "speaker string, chunk_id string, start double, end double, text string, engine string, source string, error string",
    "lane_alignments": f"speaker string, chunk_id string, start double, end double, tokens array<string>, n_skipped_words int, status string, words {_WORDS}, islands array<array<double>>, aligned_frac double, error string",
    "segments": "seg_id string, video_id string, speaker string, start double, end double, dur double, wav string, over_len boolean, source string, separated boolean, separated_s double, separated_frac double, purity double, purity_pass boolean",
    "transcripts": f"seg_id string, text string, asr string, language string, script {_SCRIPT}, error string",
    "alignments": f"seg_id string, n_words int, n_tokens int, n_skipped_words int, status string, words {_WORDS}, islands array<array<double>>, aligned_frac double, max_island_s double, clipped array<string>",
    "candidates": "seg_id string, tag string, score double, detector string, position_s double, evidence string",
    "dataset": f"sample_id string, video_id string, speaker string, speaker_label string, text string, text_plain string, line string, tags array<string>, wav string, dur double, start double, end double, split string, source string, separated_frac double, purity double, align_status string, clipped array<string>, asr string, script {_SCRIPT}",
}
# File endings of recordings.
MEDIA = ("wav", "mp3", "m4a", "mp4", "flac", "ogg", "webm")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a given schema; a missing file is an empty table, blank lines are skipped, a malformed line is an error.

    ``schema`` is DDL or the name of a table.  An object in a string column stays JSON text.
    """
    schema = SCHEMAS.get(schema, schema)
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines in the folder ``path``, visible only when whole; fields without value are left out."""
    df.write.mode("overwrite").json(path)


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object as a row; a missing file is an empty object, a row of nulls."""
    if _exists(spark, path):
        return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    empty = spark.createDataFrame([], schema)
    return spark.range(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in empty.schema))


def write_document(df: DataFrame, path: str) -> None:
    """The only row of ``df`` as one JSON object in the folder ``path``; more rows are an error."""
    if df.limit(2).count() > 1:
        raise ValueError("a document is one row")
    df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """All candidates_*.jsonl of a folder with the detector's name of each file."""
    path = posixpath.join(folder, "candidates_*.jsonl")
    if not _exists(spark, path):
        return spark.createDataFrame([], SCHEMAS["candidates"] + ", detector_name string")
    rows = spark.read.schema(SCHEMAS["candidates"]).option("mode", "FAILFAST").json(path)
    return rows.withColumn("detector_name", F.regexp_extract(F.col("_metadata.file_name"), r"^candidates_(.+)\.jsonl$", 1))


def read_corpus(spark: SparkSession, jobs: str) -> DataFrame:
    """The dataset tables of all jobs under ``jobs`` with the job's folder name; jobs without one are skipped."""
    path = posixpath.join(jobs, "*/manifests/dataset.jsonl")
    if not _exists(spark, path):
        return spark.createDataFrame([], SCHEMAS["dataset"] + ", job string")
    rows = spark.read.schema(SCHEMAS["dataset"]).option("mode", "FAILFAST").json(path)
    return rows.withColumn("job", F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/manifests/dataset\.jsonl$", 1))


def write_corpus(rows: DataFrame, out: str, copied: bool = True, jobs: str | None = None) -> None:
    """A corpus as JSON lines by speaker, its clips named by place: in the corpus if they are copied, else in their job.

    With ``jobs``, the folder of all jobs, the clips are copied as well: each task copies
    those of its rows through the file system that the folders name.
    """
    moved = F.concat(F.lit("clips/"), "speaker", F.lit("/"), "sample_id", F.lit(".wav"))
    stay = F.concat("job", F.lit("/"), "wav")
    if copied and jobs is not None:
        copy_files(rows.where("wav IS NOT NULL").select(F.concat(F.lit(jobs + "/"), stay).alias("source"), F.concat(F.lit(out + "/"), moved).alias("target")))
    rows.withColumn("wav", moved if copied else stay).withColumn("of", F.col("speaker")).write.mode("overwrite").partitionBy("of").json(posixpath.join(out, "dataset"))


def copy_files(pairs: DataFrame) -> int:
    """Copy ``source`` to ``target`` of every row, and return how many were there to copy.

    Written under another name first, so that a task that runs again leaves no half
    file.  Folders must be visible to all executors.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            done = 0
            for source, target in zip(part["source"], part["target"]):
                if os.path.exists(source):
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    shutil.copyfile(source, f"{target}.{os.getpid()}")
                    os.replace(f"{target}.{os.getpid()}", target)
                    done += 1
            yield pd.DataFrame({"n": [done]})

    return pairs.mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


def read_manifest(spark: SparkSession, job: str, name: str, schema: str) -> DataFrame:
    """A job's table or document by file name; names that leave the folder are refused, missing files are an error."""
    if name != os.path.basename(name) or name in ("", ".", ".."):
        raise ValueError(f"not a manifest name: {name}")
    path = posixpath.join(job, "manifests", name)
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    return read_document(spark, path, SCHEMAS.get(schema, schema)) if name.endswith(".json") else read_jsonl(spark, path, schema)


def list_media(spark: SparkSession, source: str) -> DataFrame:
    """(path, length) of the recordings that a folder, a glob or a file names; subfolders aren't searched."""
    endings = "*.{" + ",".join(x for e in MEDIA for x in (e, e.upper())) + "}"
    return spark.read.format("binaryFile").option("pathGlobFilter", endings).option("recursiveFileLookup", "false").load(source).select("path", "length")


def expand_sources(spark: SparkSession, sources: list[str]) -> DataFrame:
    """(place, source, kind) of what each argument names, in order: an address as it is, the recordings of a folder or a glob, or a literal that names nothing there is."""
    settle(spark)
    parts = [spark.createDataFrame([], "place int, source string, kind string")]
    for place, source in enumerate(sources):
        if "://" in source and source.split("://")[0] in ("http", "https"):
            parts.append(spark.createDataFrame([(place, source, "url")], "place int, source string, kind string"))
        elif _exists(spark, source):
            parts.append(list_media(spark, source).select(F.lit(place).alias("place"), F.col("path").alias("source"), F.lit("file").alias("kind")))
        else:
            parts.append(spark.createDataFrame([(place, source, "literal")], "place int, source string, kind string"))
    return reduce(DataFrame.unionByName, parts)


def bytes_freed(spark: SparkSession, job: str) -> int:
    """How many bytes the files of a job's folder hold, as its removal would free them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(job).select("length")
    return files.agg(F.sum("length")).first()[0] or 0


def write_embeddings(rows: DataFrame, path: str, by: str, vector: str = "embedding") -> DataFrame:
    """Store the usable vectors - no null, no zeros only, no infinite or missing number - by ``by``, and return what is stored."""
    from weftline.functions.vectors import usable

    rows.where(usable(F.col(vector))).write.mode("overwrite").partitionBy(by).parquet(path)
    return rows.sparkSession.read.parquet(path)


def run_stage(spark: SparkSession, folder: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The stored result of a stage, built only if its marker is missing or ``force``d; a build that fails leaves no marker."""
    if force or not _exists(spark, posixpath.join(folder, "_SUCCESS")):
        build().write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


def replace_part(rows: DataFrame, path: str, by: str) -> None:
    """Write ``rows`` in place of the stored rows of the same values of ``by``; other values stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def extend_cache(rows: DataFrame, path: str, key: str | list[str], compute: Callable[[DataFrame], DataFrame], failed: str = "error") -> DataFrame:
    """Results of ``compute`` for all ``rows`` by ``key``: those stored at ``path``, and the missing and failed ones, computed and appended.

    ``key`` may be several columns, such as the bounds of a window that speakers share.
    """
    from weftline.operators.rows import to_do

    keys = [key] if isinstance(key, str) else key
    spark = rows.sparkSession
    done = spark.read.parquet(path) if _exists(spark, posixpath.join(path, "_SUCCESS")) else None
    fresh = compute(rows if done is None else to_do(rows, done, keys, failed))
    fresh.write.mode("append").parquet(path)
    stored = spark.read.parquet(path)
    return stored.where(F.col(failed).isNull()).dropDuplicates(keys)


def call_in_batches(rows: DataFrame, call: Callable[[pd.DataFrame], pd.DataFrame], schema: str, key: str, size: int = 8, tries: int = 1, per_minute: float | None = None, pause: float = 1.0) -> DataFrame:
    """``call`` on at most ``size`` rows at a time, as a model or a worker wants them.

    If it raises, it is tried again up to ``tries`` times in all, after ``pause``, twice,
    four times... that many seconds; then its rows get their key and the message in
    ``error``; ``schema`` must name both.  Rows without an answer get an empty one with
    an error.  ``per_minute`` caps the calls of a task.
    """
    columns = [c.strip().split()[0] for c in schema.split(",")]

    def answered(few: pd.DataFrame) -> pd.DataFrame:
        for attempt in range(tries):
            try:
                return call(few).reindex(columns=columns)
            except Exception as e:  # noqa: BLE001
                failure = f"{type(e).__name__}: {str(e)[:120]}"
            if attempt + 1 < tries:
                time.sleep(pause * 2**attempt)
        return pd.DataFrame({key: few[key], "error": failure}).reindex(columns=columns)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        free = 0.0
        for part in parts:
            for i in range(0, len(part), size):
                few = part.iloc[i : i + size]
                time.sleep(max(0.0, free - time.monotonic()))
                free = time.monotonic() + (60 / per_minute if per_minute else 0)
                got = answered(few)
                silent = few[~few[key].isin(got[key])]
                got = pd.concat([got, pd.DataFrame({key: silent[key], "error": "no answer"}).reindex(columns=columns)]) if len(silent) else got
                yield got.astype(object).where(got.notna(), None)

    return rows.mapInPandas(run, schema)

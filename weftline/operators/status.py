"""Status tables of jobs: recovery, reconciliation with what is there, and summaries.

A status table has rows (job, kind, name, status, msg, progress); kind is stage or detector.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The stages of a job in order, and the statuses.
STAGES = ["ingest", "diarize", "clean", "asr", "align", "segment", "export"]
PENDING, QUEUED, RUNNING, DONE, ERROR = "pending", "queued", "running", "done", "error"
INTERRUPTED = "interrupted (server restart)"
SCHEMA = "job string, kind string, name string, status string, msg string, progress double"


def recovered(status: DataFrame, stages: list[str] | None = None) -> DataFrame:
    """``status`` as it is after a crash: what ran is an error, queued stages are pending again, queued detectors an error; unknown stages are dropped."""
    stage = F.col("kind") == "stage"
    broken = (F.col("status") == RUNNING) | (~stage & (F.col("status") == QUEUED))
    return status.where(~stage | F.col("name").isin(stages or STAGES)).withColumns(
        {"status": F.when(broken, ERROR).when(stage & (F.col("status") == QUEUED), PENDING).otherwise(F.col("status")), "msg": F.when(broken, INTERRUPTED).otherwise(F.col("msg"))}
    )


def reconciled(status: DataFrame, markers: DataFrame, stages: list[str] | None = None) -> DataFrame:
    """(job, place, name, status, msg, progress): every stage of every job in order, as its marker says.

    ``markers`` (job, name) are the stages whose result is there: they are done,
    whatever was noted; what was noted as done without one is pending; stages without
    a note are pending.
    """
    jobs = status.select("job").distinct()
    order = F.posexplode(F.array(*map(F.lit, stages or STAGES))).alias("place", "name")
    noted = status.where("kind = 'stage'").select("job", "name", "status", "msg", "progress")
    there = markers.select("job", "name").distinct().withColumn("_there", F.lit(True))
    rows = jobs.select("job", order).join(noted, ["job", "name"], "left").join(there, ["job", "name"], "left")
    was, fresh = F.coalesce("status", F.lit(PENDING)), F.coalesce("_there", F.lit(False))
    gone = ~fresh & (was == DONE)
    changed = (fresh & (was != DONE)) | gone
    return rows.select(
        "job", "place", "name", F.when(fresh, DONE).when(gone, PENDING).otherwise(was).alias("status"),
        F.when(changed, "").otherwise(F.col("msg")).alias("msg"), F.when(fresh & changed, 1.0).when(gone, 0.0).otherwise(F.col("progress")).alias("progress"),
    )


def queue_summary(status: DataFrame) -> DataFrame:
    """One row: how many wait, how many run, and job, kind and name of the first that runs (stages before detectors)."""
    rank = F.struct((F.col("kind") != "stage").alias("d"), "job", "name", "kind")
    first = F.min(F.when(F.col("status") == RUNNING, rank))
    return status.agg(F.count_if(F.col("status") == QUEUED).alias("queue_len"), F.count_if(F.col("status") == RUNNING).alias("running"), first.alias("f")).select("queue_len", "running", F.col("f.job").alias("job"), F.col("f.kind").alias("kind"), F.col("f.name").alias("name"))


def job_summary(status: DataFrame, rows: DataFrame, job: str = "video_id", detail: str = "dur") -> DataFrame:
    """(job, done, failed, next_stage, n_rows, minutes): how far each job is and what it has given.  ``status`` as reconciled() gives it; ``rows`` are its dataset rows."""
    w = status.groupBy("job").agg(F.count_if(F.col("status") == DONE).alias("done"), F.count_if(F.col("status") == ERROR).alias("failed"), F.min(F.when(F.col("status") != DONE, F.struct("place", "name"))).alias("n"))
    got = rows.groupBy(F.col(job).alias("job")).agg(F.count("*").alias("n_rows"), F.sum(F.floor(F.col(detail) * 1000 + 0.5).cast("long")).alias("ms"))
    return w.join(got, "job", "left").select("job", "done", "failed", F.col("n.name").alias("next_stage"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), (F.floor(F.coalesce("ms", F.lit(0)) / 6000 + 0.5) / 10).alias("minutes"))


def log_progress(log: DataFrame, longest: int = 300) -> DataFrame:
    """(job, name, msg, progress) as reported last: messages cut to ``longest`` characters, progress to three places.  ``log`` has job, name, at, msg and progress."""
    w = Window.partitionBy("job", "name").orderBy(F.col("at").desc())
    last = log.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return last.select("job", "name", F.substring("msg", 1, longest).alias("msg"), (F.floor(F.col("progress") * 1000 + 0.5) / 1000).alias("progress"))

"""Structured Streaming over tables that grow: windows, sessions and rows written again."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.operators.rows import latest
from weftline.runtime import settle


def stream_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A table as a stream of its files, whether it is one file or a folder of parts."""
    path = f"{directory}/{name}.parquet"
    settle(spark)
    schema = spark.read.parquet(path).schema
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    folder = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
    stream = spark.readStream.schema(schema)
    return stream.parquet(path) if folder else stream.option("pathGlobFilter", f"{name}.parquet").parquet(directory)


def stream_lines(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """JSON lines as a stream of the files that are added to ``folder``, by a schema (DDL, or the name of a table)."""
    from weftline.sources.manifests import SCHEMAS

    return settle(spark).readStream.schema(SCHEMAS.get(schema, schema)).option("mode", "FAILFAST").json(folder)


def lines_done(lines: DataFrame, keys: list[str], total: int, error: str = "error") -> DataFrame:
    """(keys..., done, failed, progress): how many lines a worker has given so far, of ``total`` expected; works on streams and on tables."""
    counts = lines.groupBy(*keys).agg(F.count("*").alias("done"), F.count(error).alias("failed"))
    return counts.withColumn("progress", F.floor(F.col("done") / max(1, total) * 1000 + 0.5) / 1000)


def event_windows(events: DataFrame, time: str, keys: list[str], value: str, width: str = "1 hour", late: str = "2 days") -> DataFrame:
    """(keys..., window_start, n, total): events counted in windows, open for ``late``."""
    stamped = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return stamped.groupBy(*keys, F.window("_t", width).alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(*keys, F.col("w.start").alias("window_start"), "n", "total")


def sessions(events: DataFrame, time: str, keys: list[str], gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """(keys..., session_start, session_end, n): point events merged where they follow each other within ``gap``."""
    stamped = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return stamped.groupBy(*keys, F.session_window("_t", gap).alias("w")).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def current(spark: SparkSession, path: str, before: int | None = None, parts: list[int] | None = None) -> DataFrame:
    """The table kept by upsert_latest: of each part the last version (below ``before``), of all or some ``parts``."""
    rows = settle(spark).read.parquet(path)
    known = rows.select("part", "version").distinct()
    known = known if before is None else known.where(F.col("version") < before)
    known = known if parts is None else known.where(F.col("part").isin(parts))
    last = [(r["part"], r["v"]) for r in known.groupBy("part").agg(F.max("version").alias("v")).collect()]
    chosen = F.lit(False)
    for part, version in last:
        chosen = chosen | ((F.col("part") == part) & (F.col("version") == version))
    return rows.where(chosen)


def upsert_latest(stream: DataFrame, path: str, checkpoint: str, keys: list[str], written: str = "written_at", parts: int = 16) -> StreamingQuery:
    """Keep the row of each key written last in the table at ``path``, which has ``parts`` parts by key; read it with current().

    A batch writes a new version of the parts that it touches only, from their version
    before it and its own rows.  A batch that runs again after a failure replaces its
    own versions, so nothing is lost or counted twice.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = settle(batch.sparkSession)
        rows = batch.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
        touched = [r[0] for r in rows.select("part").distinct().collect()]
        if not touched:
            return
        both = current(spark, path, number, touched).drop("version").unionByName(rows) if number else rows
        fresh = latest(both, keys, written).withColumn("version", F.lit(number))
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "version").parquet(path)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """What a stream yields once all its present input is read, as a table in the shared checkpoint folder."""
    spark = stream.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        from weftline.runtime import checkpoint

        checkpoint(spark.range(1))
    base = posixpath.join(context.getCheckpointDir(), f"stream-{uuid.uuid4().hex}")
    out = posixpath.join(base, "out")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else posixpath.join(out, f"batch={number}"))

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", posixpath.join(base, "state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)

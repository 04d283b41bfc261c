"""Session, checkpoint and join helpers shared by all operators."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that may be broadcast or collected after its size was checked.
SMALL_ROWS = 100_000

#: A key is hot when it holds more than one HOT_PARTS-th of the rows, so that there are fewer hot keys than this.
HOT_PARTS = 256


def local_session(app: str = "weftline", cores: str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores or os.environ.get('BENCH_CPUS', '8')}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def load_env(path: str) -> dict[str, str]:
    """NAME=value lines of a file as environment variables, unless they are set already; comments and blank lines count for nothing, a missing file has none."""
    found: dict[str, str] = {}
    if os.path.isfile(path):
        with open(path, encoding="utf-8") as lines:
            for line in lines:
                name, sign, value = line.strip().partition("=")
                if sign and name.strip() and not name.startswith("#"):
                    found[name.strip()] = value.strip().strip("'\"")
    for name, value in found.items():
        os.environ.setdefault(name, value)
    return found


def settle(spark: SparkSession) -> SparkSession:
    """Set what right results need: Spark 4.1 lets a union keep its children's partitioning although adaptive execution may coalesce each child in its own way, and a grouping above then misses rows."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` through the folder the session names in spark.checkpoint.dir.

    The folder is shared by all executors, so a lost executor loses nothing.  Only
    a session that names no folder (tests on one machine) gets one of its own.  What
    is written there is removed once no DataFrame needs it any more.
    """
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _checkpoint_folder(spark: SparkSession) -> str:
    context = settle(spark).sparkContext
    context._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="weftline-checkpoint-"))
    return context.getCheckpointDir()


@contextlib.contextmanager
def shared_folder(spark: SparkSession) -> Iterator[str]:
    """A folder of its own beside the checkpoints, which all executors share; it is removed at the end."""
    folder = f"{_checkpoint_folder(spark)}/weftline-{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def checkpoint_with(df: DataFrame, **figures: Column) -> tuple[DataFrame, dict]:
    """checkpoint() of ``df``, and aggregates over its rows that are taken while they are written."""
    seen = Observation()
    kept = checkpoint(df.observe(seen, *(c.alias(name) for name, c in figures.items())))
    return kept, seen.get


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return settle(spark).read.parquet(f"{directory}/{name}.parquet")


def small(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` rows, else ``df`` as it is (a shuffled join)."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def blank(c: Column) -> Column:
    """True for null and empty strings and those of white space only."""
    return F.coalesce(~c.rlike(r"(?U)\S"), F.lit(True))


def computed(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """withColumns() whose values are computed once a row.

    Else the optimizer may put their expressions where they are named, and within a
    function on an array they would be computed for every element; a generator of one
    row keeps them apart.
    """
    kept = [c for c in rows.columns if c not in columns]
    return rows.select(*kept, F.inline(F.array(F.struct(*(v.alias(k) for k, v in columns.items())))))


def spread_join(rows: DataFrame, lookup: DataFrame, key: str, count: str, total: Column | int, how: str = "inner") -> DataFrame:
    """Join ``rows`` with ``lookup``, which has one row per ``key`` and the number of matching rows in ``count``.

    Keys with more than total/HOT_PARTS rows are at most HOT_PARTS many: their lookup
    rows are broadcast and their rows stay where they are.  All others take a
    shuffled join in which no key is large.  ``how`` is inner or left.
    """
    settle(rows.sparkSession)
    hot = lookup.where(F.col(count) * HOT_PARTS > total)
    plain = lookup.join(F.broadcast(hot.select(key)), key, "left_anti")
    return (
        rows.join(F.broadcast(hot), key)
        .unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(plain, key, how))
        .drop(count)
    )


def ship(spark: SparkSession) -> None:
    """Settle the session, and send this package to the executors unless their Python finds it already (PYTHONPATH or working directory of a local session)."""
    import zipfile

    settle(spark)

    import weftline

    root = os.path.dirname(os.path.dirname(os.path.abspath(weftline.__file__)))
    visible = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    context = spark.sparkContext
    if root in visible or (context.master.startswith("local[") and os.getcwd() == root) or getattr(context, "_weftline_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="weftline-package-"), "weftline.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(os.path.join(root, "weftline")):
            for name in files:
                if name.endswith(".py"):
                    z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), root))
    context.addPyFile(path)
    context._weftline_shipped = True

"""Command line: collect the corpus of all jobs, or run a query.

    python -m weftline collect JOBS OUT [--no-copy]
    python -m weftline query NAME DIRECTORY [--out FOLDER] [--force]
    python -m weftline queries
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weftline.operators import export
from weftline.plans import core
from weftline.runtime import load_env, local_session, ship
from weftline.sources import manifests


def collect(spark: SparkSession, jobs: str, out: str, copied: bool = True) -> dict[str, float]:
    """Write the corpus of all jobs and its matrix to ``out``; rows, minutes and speakers."""
    rows = manifests.read_corpus(spark, jobs)
    manifests.write_corpus(rows, out, copied, jobs if copied else None)
    export.matrix(rows).write.mode("overwrite").json(f"{out}/matrix")
    n, ms, speakers = rows.agg(F.count("*"), F.sum(F.floor(F.col("dur") * 1000 + 0.5).cast("long")), F.countDistinct("speaker")).first()
    return {"rows": n, "minutes": int((ms or 0) / 6000 + 0.5) / 10, "speakers": speakers}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict | list | None:
    parser = argparse.ArgumentParser(prog="weftline")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("collect")
    one.add_argument("jobs")
    one.add_argument("out")
    one.add_argument("--no-copy", action="store_true", help="leave clips in their jobs")
    two = commands.add_parser("query")
    two.add_argument("name", choices=sorted(core.QUERIES))
    two.add_argument("directory")
    two.add_argument("--out", help="keep the result here; what is there is read again")
    two.add_argument("--force", action="store_true", help="make the result anew")
    commands.add_parser("queries")
    given = parser.parse_args(argv)
    load_env(".env")
    if given.command == "queries":
        print(*sorted(core.QUERIES), sep="\n")
        return sorted(core.QUERIES)
    spark = spark or local_session()
    ship(spark)
    if given.command == "collect":
        told = collect(spark, given.jobs, given.out, not given.no_copy)
        print(f"{told['rows']} rows, {told['minutes']} min, {told['speakers']} speakers")
        return told
    build = lambda: core.QUERIES[given.name](spark, given.directory)
    df = manifests.run_stage(spark, given.out, build, given.force) if given.out else build()
    df.show(truncate=False)
    return None


if __name__ == "__main__":
    main()

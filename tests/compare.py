"""Compares a query with its SQL in DuckDB, as sets of rows with their repetitions."""

import glob
import math
import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def compare(spark, con, query, sql):
    df = query(spark, DATA)
    names = sorted(df.columns)
    mine = sorted(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())
    answer = con.execute(sql)
    columns = [x[0] for x in answer.description]
    kinds = {x[0]: str(x[1]) for x in answer.description}
    assert sorted(columns) == names
    assert {c: TYPES[t] for c, t in df.dtypes if t in TYPES} == {c: kinds[c] for c, t in df.dtypes if t in TYPES}
    at = [columns.index(c) for c in names]
    assert mine == sorted(repr(tuple(plain(r[i]) for i in at)) for r in answer.fetchall())

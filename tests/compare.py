"""Rows of a Spark query against those of its SQL in DuckDB."""

import math
import os

import duckdb
import numpy as np

SF = "/root/testdata/sf0.001"


def connect(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf}/{name}'")
    return con


def plain(v):
    if v is None or str(v) in ("<NA>", "NaT") or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(int(v))
    if isinstance(v, (int, np.integer)):
        return str(int(v))
    if isinstance(v, (float, np.floating)):
        return str(int(v)) if v == int(v) and abs(v) < 1e15 else f"{v:.6f}"
    return str(v)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False, name=None))

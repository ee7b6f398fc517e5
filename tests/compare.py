"""Rows of a DataFrame and of DuckDB in one form."""

import glob
import os
from decimal import Decimal

import duckdb
import numpy as np

SF = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, (list, tuple, np.ndarray)):
        return tuple(plain(v) for v in value)
    if isinstance(value, Decimal):
        return float(value)
    return value


def duck(sql: str, sf_dir: str = SF):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW \"{os.path.basename(path)[:-8]}\" AS SELECT * FROM '{path}'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(repr(tuple(plain(r[i]) for i in order)) for r in found.fetchall())


def rows(df):
    names = sorted(df.columns)
    return names, sorted(repr(tuple(plain(r[n]) for n in names)) for r in df.collect())

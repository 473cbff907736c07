"""Compares a query's rows with its SQL's, run by DuckDB over the same files."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    return round(value, 9) if isinstance(value, float) and not math.isnan(value) else value


def differences(got, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """'' if both have the same columns and rows, whatever the order; else what differs."""
    want = con.execute(sql)
    names = sorted(d[0] for d in want.description)
    if names != sorted(got.columns):
        return f"columns {sorted(got.columns)}, not {names}"
    at = {d[0]: i for i, d in enumerate(want.description)}
    right = sorted((tuple(_plain(r[at[n]]) for n in names) for r in want.fetchall()), key=repr)
    left = sorted((tuple(_plain(r[n]) for n in names) for r in got.collect()), key=repr)
    if not right:
        return "the SQL gives no rows, so nothing is compared"
    if left != right:
        odd = [(a, b) for a, b in zip(left, right, strict=False) if a != b][:2]
        return f"{len(left)} rows, not {len(right)}; first differences {odd}"
    return ""

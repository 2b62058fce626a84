"""Comparison of a query with its SQL in DuckDB."""

import collections
import os

import duckdb
import numpy as np
import pandas as pd


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if v is None or v is pd.NA or not isinstance(v, (str, dict)) and v != v:
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (float, np.floating)):
        return round(float(v), 6)
    return int(v) if isinstance(v, np.integer) else v


def counted(df: pd.DataFrame, columns: list[str]) -> collections.Counter:
    return collections.Counter(tuple(plain(v) for v in r) for r in df[columns].itertuples(index=False))


def connect(folder: str):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(folder):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    return c


def assert_same(found: pd.DataFrame, expected: pd.DataFrame) -> None:
    columns = sorted(expected.columns)
    assert sorted(found.columns) == columns
    a, b = counted(expected, columns), counted(found, columns)
    assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])

"""Side-by-side comparison of a query with its SQL in DuckDB."""

from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = Path(folder, f"{t}.parquet")
        con.sql(f"create view {t} as select * from '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def cell(v) -> str:
    if v is None or v is pd.NaT or isinstance(v, float) and v != v:
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, float, np.integer, np.floating)):
        return repr(round(float(v), 6) + 0.0)
    return str(v)


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].map(cell)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def assert_same(found: pd.DataFrame, wanted: pd.DataFrame) -> None:
    assert sorted(found.columns) == sorted(wanted.columns)
    pd.testing.assert_frame_equal(normal(found), normal(wanted))

"""Holding a Spark result against DuckDB's: same columns, same rows, floats to nine digits."""

import glob
import math
import os

import duckdb
import pandas as pd


def connect(sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con


def _cell(v):
    if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    if isinstance(v, (int, float)) or hasattr(v, "dtype"):
        return float(v)
    return str(v)[:19] if hasattr(v, "isoformat") else str(v)


def _table(df):
    df = df[sorted(df.columns)]
    text = lambda v: "" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(([_cell(v) for v in r] for r in df.itertuples(index=False)), key=lambda r: ["" if isinstance(x, float) else text(x) for x in r] + [text(x) for x in r])


def differences(a, b):
    if sorted(a.columns) != sorted(b.columns):
        return [f"columns {sorted(a.columns)} and {sorted(b.columns)}"]
    x, y = _table(a), _table(b)
    if len(x) != len(y):
        return [f"{len(x)} rows and {len(y)}"]
    close = lambda u, v: math.isclose(u, v, rel_tol=1e-9, abs_tol=1e-11) if isinstance(u, float) and isinstance(v, float) else u == v
    return [f"{p} and {q}" for p, q in zip(x, y) if not all(map(close, p, q))][:3]

"""Shared comparison used by the tests: Spark result vs DuckDB oracle, order-insensitive."""

import math

import duckdb

from tablewright.sources.tables import TABLE_NAMES


def canon(v):
    if v is None:
        return "NULL"
    try:
        import pandas as pd
        if v is pd.NA or v is pd.NaT:
            return "NULL"
    except Exception:
        pass
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return repr(float(v))
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return canon(v.item())
        except Exception:
            pass
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    if hasattr(v, "tolist"):
        return canon(v.tolist())
    return str(v)


def rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(tuple(canon(v) for v in r) for r in pdf[cols].itertuples(index=False, name=None))


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLE_NAMES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con

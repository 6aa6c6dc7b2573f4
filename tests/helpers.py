"""Comparison helpers shared by the tests (same normalisation as the driver check)."""

import math


def norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (0, "")
        return (1, repr(round(v, 6) + 0.0))
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return (1, str(int(v)))
    return (1, str(v))


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = sorted(tuple(norm(v) for v in rec) for rec in pdf[cols].itertuples(index=False, name=None))
    return cols, out


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{sf_dir}/events.parquet')")
    return con

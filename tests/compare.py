"""Run a query in Spark and its SQL in DuckDB, and compare them as sets of rows."""

from __future__ import annotations

import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}/*.parquet')" if os.path.isdir(p) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if type(x).__name__ == "Decimal":
        return float(x)
    return x


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


def same(spark_df, con, sql):
    """None if equal, else a short account of the difference."""
    a_cols, a = rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    rel = con.execute(sql)
    b_cols, b = rows([c[0] for c in rel.description], rel.fetchall())
    if a_cols != b_cols:
        return f"columns {a_cols} and {b_cols}"
    if len(a) != len(b):
        only = sorted(set(a) - set(b), key=repr)[:2], sorted(set(b) - set(a), key=repr)[:2]
        return f"{len(a)} and {len(b)} rows: {only}"
    odd = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(odd)} of {len(a)} rows differ: {odd[:2]}" if odd else None

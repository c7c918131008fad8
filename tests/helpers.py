"""Comparison of a query's rows with its SQL's in DuckDB."""

from __future__ import annotations

import os

import duckdb


def norm(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6)
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return tuple(norm(x) for x in v) if isinstance(v, (list, tuple)) else v


def connect(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)


def sql_rows(con, sql):
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted((tuple(norm(r[i]) for i in order) for r in rel.fetchall()), key=repr)

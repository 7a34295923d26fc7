"""Comparing a Spark result with the same tables queried by DuckDB."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)):
        f = float(v)
        return "nan" if math.isnan(f) else f"{round(f, 9):.9g}" if abs(f) < 1e15 else str(v)
    return str(v)


def spark_rows(df):
    names = sorted(df.columns)
    assert len(set(names)) == len(names), names
    return names, sorted(tuple(cell(r[n]) for n in names) for r in df.collect())


def sql_rows(con, sql):
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    names = sorted(cols)
    at = [cols.index(n) for n in names]
    return names, sorted(tuple(cell(r[i]) for i in at) for r in res.fetchall())


KINDS = {
    "int": {"tinyint", "smallint", "int", "integer", "bigint"},
    "float": {"double", "float"},
    "text": {"string", "varchar"},
    "bool": {"boolean"},
}


def kind(type_name: str) -> str:
    return next((k for k, names in KINDS.items() if type_name.lower() in names), type_name)


def difference(df, con, sql) -> str | None:
    """None when equal, else a short description."""
    ours = {c: kind(t) for c, t in df.dtypes}
    theirs = {r[0]: kind(r[1]) for r in con.execute("describe " + sql).fetchall()}
    if ours != theirs:
        return f"types {ours} != {theirs}"
    sn, sr = spark_rows(df)
    dn, dr = sql_rows(con, sql)
    if sn != dn:
        return f"columns {sn} != {dn}"
    if sr != dr:
        only_s = sorted(set(sr) - set(dr))[:3]
        only_d = sorted(set(dr) - set(sr))[:3]
        return f"rows {len(sr)} vs {len(dr)}; {sn}; spark only {only_s}; sql only {only_d}"
    return None

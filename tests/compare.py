"""Side-by-side comparison of a Spark result and its SQL check in DuckDB."""

from __future__ import annotations

import glob
import os
import time

import duckdb

from __spark_entry__ import oracle_sql, queries


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_text(r[i]) for i in order) for r in rows)


def _text(v) -> str:
    if v is None or (isinstance(v, float) and v != v):
        return "NULL"
    if hasattr(v, "normalize"):
        return str(v.normalize())
    return repr(v)


KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP", "date": "DATE",
}


def compare(spark, con, key: str, sf_dir: str) -> dict:
    start = time.time()
    df = queries()[key](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    out = {"key": key, "rows": len(got), "sec": round(took, 2), "checked": False, "ok": True}
    sql = oracle_sql().get(key)
    if sql is None:
        return out
    start = time.time()
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    types = dict(zip(names, [str(d[1]) for d in res.description]))
    want = res.fetchall()
    out["duck_sec"] = round(time.time() - start, 2)
    out["checked"] = True
    problems = []
    if sorted(names) != sorted(df.columns):
        problems.append(f"columns {sorted(df.columns)} != {sorted(names)}")
    else:
        for name, kind in df.dtypes:
            if kind in KINDS and types[name] != KINDS[kind]:
                problems.append(f"type of {name}: {kind} vs {types[name]}")
        a, b = _rows(df.columns, got), _rows(names, want)
        if len(a) != len(b):
            problems.append(f"{len(a)} rows != {len(b)}")
        if a != b:
            extra, missing = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
            problems.append(f"values of {sorted(names)}: spark {extra} sql {missing}")
    out["ok"], out["problems"] = not problems, problems
    return out

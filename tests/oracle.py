"""Side-by-side check of a registered Spark query against its DuckDB oracle."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

from equiscope.sources.tables import TABLES

SPARK_TO_DUCK = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE",
    "date": "DATE", "smallint": "SMALLINT", "tinyint": "TINYINT", "float": "FLOAT",
}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 4)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    return v


def compare(spark_df, con, sql: str) -> list[str]:
    """Return a list of mismatch descriptions (empty when equal)."""
    problems = []
    sdf = spark_df
    s_types = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
    rel = con.sql(sql)
    d_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    if sorted(s_types) != sorted(d_types):
        return [f"columns differ: spark={sorted(s_types)} duck={sorted(d_types)}"]
    for c in s_types:
        st = SPARK_TO_DUCK.get(s_types[c], s_types[c].upper())
        if st != d_types[c] and not (s_types[c].startswith(("array", "struct", "map"))):
            problems.append(f"type {c}: spark={s_types[c]} duck={d_types[c]}")
    cols = sorted(s_types)
    srows = [tuple(_norm(r[c]) for c in cols) for r in sdf.collect()]
    dpdf = rel.fetchall()
    didx = [rel.columns.index(c) for c in cols]
    drows = [tuple(_norm(r[i]) for i in didx) for r in dpdf]
    if len(srows) != len(drows):
        problems.append(f"row count spark={len(srows)} duck={len(drows)}")
    key = lambda r: tuple((x is None, str(x)) for x in r)
    srows.sort(key=key)
    drows.sort(key=key)
    bad = 0
    for a, b in zip(srows, drows):
        if a != b:
            bad += 1
            if bad <= 3:
                problems.append(f"row differs:\n  spark={a}\n  duck ={b}")
    if bad:
        problems.append(f"{bad} differing rows")
    return problems

"""Runs a registered query and its SQL side by side and explains the first difference."""

from __future__ import annotations

import math
import time
from pathlib import Path

import duckdb

TYPES = {
    "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE",
    "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads TO 8")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def _key(row):
    return tuple((v is None, str(type(v)), v if not isinstance(v, float) or not math.isnan(v) else 0.0) if not isinstance(v, (list, dict)) else (False, "", str(v)) for v in row)


def compare(spark, con, name, fn, sql, sf_dir) -> tuple[list[str], int, float, float]:
    problems: list[str] = []
    t0 = time.time()
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    t1 = time.time()
    if sql is None:
        return problems, len(rows), t1 - t0, 0.0
    desc = con.execute(f"DESCRIBE {sql}").fetchall() if not sql.strip().upper().startswith("WITH") else None
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    data = cur.fetchall()
    t2 = time.time()
    if sorted(names) != cols:
        return [f"columns spark={cols} sql={sorted(names)}"], len(rows), t1 - t0, t2 - t1
    for f in df.schema.fields:
        want = TYPES.get(f.dataType.simpleString())
        got = types[f.name]
        if want is not None and got != want:
            problems.append(f"type of {f.name}: spark {want} sql {got}")
    order = [names.index(c) for c in cols]
    other = [tuple(r[i] for i in order) for r in data]
    if len(rows) != len(other):
        problems.append(f"rows spark={len(rows)} sql={len(other)}")
    a, b = sorted(rows, key=_key), sorted(other, key=_key)
    bad = [(x, y) for x, y in zip(a, b) if x != y and not all(
        u == v or (isinstance(u, float) and isinstance(v, float) and math.isnan(u) and math.isnan(v)) for u, v in zip(x, y))]
    if bad:
        x, y = bad[0]
        diff = {c: (u, v) for c, u, v in zip(cols, x, y) if u != v}
        problems.append(f"{len(bad)} rows differ, first: {diff} in {dict(zip(cols, x))}")
    return problems, len(rows), t1 - t0, t2 - t1

"""Rows of a query beside the rows that its SQL gives in DuckDB."""

from __future__ import annotations

import math
import os
from glob import glob
from pathlib import Path


def rows_of_sql(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    import duckdb

    con = duckdb.connect()
    for path in glob(f"{sf_dir}/*.parquet"):
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM read_parquet('{source}')")
    con.execute("SET TimeZone = 'UTC'")
    got = con.execute(sql)
    return [c[0] for c in got.description], got.fetchall()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if hasattr(x, "asDict"):
        return tuple(plain(v) for v in x)
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if isinstance(x, list | tuple):
        return tuple(plain(v) for v in x)
    if isinstance(x, bytearray | memoryview):
        return bytes(x)
    return x


def same(df, sql: str, sf_dir: str) -> None:
    names, expected = rows_of_sql(sql, sf_dir)
    assert sorted(df.columns) == sorted(names)
    got = [tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()]
    at = [names.index(c) for c in sorted(names)]
    want = [tuple(plain(r[i]) for i in at) for r in expected]
    got.sort(key=repr)
    want.sort(key=repr)
    assert len(got) == len(want), (len(got), len(want))
    wrong = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    assert not wrong, (len(wrong), sorted(names), wrong[:3])

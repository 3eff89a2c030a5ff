"""Holds a query's rows against its SQL in DuckDB, on the same Parquet tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, list):
        return tuple(map(_plain, v))
    return str(v) if v is not None and not isinstance(v, (int, str, bool)) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def by_sql(sql: str, sf_dir: str = SF):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return sorted(names), rows_of(names, got.fetchall())


def by_spark(df):
    return sorted(df.columns), rows_of(df.columns, [tuple(r) for r in df.collect()])


def assert_same(df, sql: str, sf_dir: str = SF) -> int:
    names, want = by_sql(sql, sf_dir)
    own, got = by_spark(df)
    assert own == names, (own, names)
    if got != want:
        odd = [(a, b) for a, b in zip(got, want) if a != b][:3]
        raise AssertionError(f"{len(got)} and {len(want)} rows; first different: {odd}")
    return len(got)

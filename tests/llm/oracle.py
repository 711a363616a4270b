"""Runs a query in Spark and its SQL in DuckDB over the same small tables."""

import duckdb


def rows(frame):
    names = sorted(frame.columns)
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=repr)


def same(frame, sql, **tables):
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(name, t)
    got = con.sql(sql)
    by = sorted(range(len(got.columns)), key=lambda i: got.columns[i])
    assert sorted(frame.columns) == sorted(got.columns)
    want = sorted((tuple(r[i] for i in by) for r in got.fetchall()), key=repr)
    have = rows(frame)
    assert len(want) == len(have)
    for a, b in zip(have, want, strict=True):
        assert a == b

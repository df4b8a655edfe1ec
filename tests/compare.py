"""Spark rows against DuckDB rows, in any order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _key(row):
    return tuple("" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v) for v in row)


def assert_equal_rows(df, sql, sf):
    names = sorted(df.columns)
    ours = sorted((tuple(r[n] for n in names) for r in df.collect()), key=_key)
    found = connection(sf).execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    theirs = sorted((tuple(r[columns.index(n)] for n in names) for r in found.fetchall()), key=_key)
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs):
        for n, x, y in zip(names, a, b):
            if isinstance(x, (int, float)) and isinstance(y, (int, float)) and not isinstance(x, bool):
                assert math.isclose(x, float(y), rel_tol=1e-6, abs_tol=1e-6), (n, a, b)
            else:
                assert str(x) == str(y), (n, a, b)

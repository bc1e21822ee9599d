"""Compares a query's rows with those of its SQL, in any order."""

import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf=SF):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(x):
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, float) or hasattr(x, "as_tuple"):
        return repr(round(float(x), 6) + 0.0)
    if isinstance(x, (list, tuple)):
        return str([plain(y) for y in x])
    return str(x)


def rows(data, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


def assert_same(df, sql, sf=SF):
    cur = connect(sf).execute(sql)
    columns = [x[0] for x in cur.description]
    assert sorted(df.columns) == sorted(columns)
    got, want = rows([tuple(r) for r in df.collect()], df.columns), rows(cur.fetchall(), columns)
    assert got == want

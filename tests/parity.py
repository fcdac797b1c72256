"""Rows of a query and of its SQL, made comparable."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        f = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    return con


def plain(rows):
    def one(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else round(x + 0.0, 5)
        return float(x) if not isinstance(x, (str, bool, int, type(None), list)) else x

    return sorted((tuple(one(x) for x in r) for r in rows), key=repr)


def differs(df, con, sql):
    want = con.sql(sql)
    columns = sorted(want.columns)
    assert sorted(df.columns) == columns, (df.columns, want.columns)
    got = plain(df.select(*columns).collect())
    exp = plain(want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())
    got = [tuple(float(x) if isinstance(x, int) and not isinstance(x, bool) else x for x in r) for r in got]
    exp = [tuple(float(x) if isinstance(x, int) and not isinstance(x, bool) else x for x in r) for r in exp]
    return None if got == exp else (len(got), len(exp), [x for x in got if x not in exp][:3], [x for x in exp if x not in got][:3])

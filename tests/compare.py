"""Comparison of a query with its SQL."""

import math
import os
from collections import Counter

import duckdb


def connection(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in sorted(os.listdir(folder)):
        path = os.path.join(folder, f)
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return repr(v)


def rows_of(df):
    columns = sorted(df.columns)
    return columns, Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())


def rows_of_sql(con, sql):
    cursor = con.execute(sql)
    names = [x[0] for x in cursor.description]
    at = [names.index(c) for c in sorted(names)]
    return sorted(names), Counter(tuple(plain(r[i]) for i in at) for r in cursor.fetchall())

"""Compare a query with its SQL on the same tables, as sorted rows of text."""

import math
import numbers
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA:
        return ""
    if isinstance(value, numbers.Real) and not isinstance(value, (bool, int)):
        value = float(value)
        return "" if math.isnan(value) else f"{value:.9g}"
    return str(value)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(plain(v) for v in r) for r in frame.itertuples(index=False))


def same(spark, con, query, sql, sf_dir):
    a, b = query(spark, sf_dir).toPandas(), con.execute(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)

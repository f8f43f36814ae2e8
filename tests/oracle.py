"""Compares a query's rows with those of its SQL in DuckDB."""

import math
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    db = duckdb.connect()
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return db


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def plain(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
            return ""
        return f"{float(x):.9g}" if isinstance(x, (int, float)) and not isinstance(x, bool) or type(x).__module__ == "numpy" and x.dtype.kind in "if" else str(x)

    return sorted(tuple(map(plain, r)) for r in df.itertuples(index=False, name=None))


def same(spark, query, sql: str, folder: str) -> None:
    got, want = query(spark, folder).toPandas(), connect(folder).sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)

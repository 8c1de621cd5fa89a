"""DuckDB over the same tables, and comparison of results without regard to order."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def _plain(x):
    if pd.api.types.is_scalar(x) and pd.isna(x):
        return None
    if hasattr(x, "item"):
        x = x.item()
    return float(x) if isinstance(x, int) and not isinstance(x, bool) else x


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(_plain, r)) for r in frame.astype(object).values.tolist()), key=repr)


def same(spark_frame, duck_frame):
    assert sorted(spark_frame.columns) == sorted(duck_frame.columns)
    assert rows(spark_frame) == rows(duck_frame)

"""Compare a Spark result with a DuckDB one, as sorted rows by column name."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(path):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    return c


def _cell(v):
    if v is None or v is pd.NA or v != v:
        return "~"
    return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(_cell, r)) for r in frame.itertuples(index=False))

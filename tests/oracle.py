"""A local copy of the comparison: every query with SQL against DuckDB on the same tables."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("AGRISPARK_TESTDATA", "/root/testdata")


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        if p.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    clean = lambda v: None if v is None or v is pd.NA or v != v else float(v) if isinstance(v, float) or type(v).__name__ == "Decimal" else v.item() if hasattr(v, "item") else v
    return sorted((tuple(clean(v) for v in r) for r in frame.itertuples(index=False, name=None)), key=repr)


def same(spark_df, con, sql: str) -> str:
    """Empty if both give the same rows, else what differs first."""
    want = con.execute(sql).fetch_df()
    got = spark_df.toPandas()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = rows(got), rows(want)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    for x, y in zip(a, b, strict=True):
        if x != y and not all(p == q or isinstance(p, float) and isinstance(q, (int, float)) and abs(p - q) <= 1.1e-6 * max(1, abs(p)) for p, q in zip(x, y, strict=True)):
            return f"{x} and {y}"
    return ""

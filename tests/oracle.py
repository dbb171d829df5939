"""Comparing a query's rows with DuckDB's."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(value) -> str:
    if value is None or value is pd.NA or value is pd.NaT or (isinstance(value, float) and value != value):
        return "null"
    if isinstance(value, float):
        return str(int(value)) if value == int(value) else f"{value:.9g}"
    return str(value)


def rows(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    columns = sorted(frame.columns)
    return sorted(tuple(canon(v) for v in r) for r in frame[columns].itertuples(index=False, name=None))


def expected(sql: str, sf_dir: str) -> pd.DataFrame:
    with duckdb.connect() as db:
        for t in TABLES:
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        return db.sql(sql).df()

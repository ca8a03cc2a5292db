"""Runs a query and its SQL on the same tables and reports the first difference."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, int) and not isinstance(value, bool):
        return repr(value)
    return repr(value)


def difference(spark_df, con, sql: str) -> str | None:
    """None if both give the same columns, types of values and rows in any order."""
    result = con.execute(sql)
    sql_cols = [c[0] for c in result.description]
    cols = sorted(sql_cols)
    if cols != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {cols}"
    order = [sql_cols.index(c) for c in cols]
    want = sorted(tuple(_plain(row[i]) for i in order) for row in result.fetchall())
    got = sorted(tuple(_plain(v) for v in row) for row in spark_df.select(*[f"`{c}`" for c in cols]).collect())
    if len(want) != len(got):
        return f"{len(got)} rows != {len(want)}; only spark {list(set(got) - set(want))[:2]}; only sql {list(set(want) - set(got))[:2]}"
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    if wrong:
        g, w = wrong[0]
        cells = [(c, a[:200], b[:200]) for c, a, b in zip(cols, g, w) if a != b]
        return f"{len(wrong)} of {len(want)} rows differ, first: {cells}"
    return None

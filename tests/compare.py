"""Results of Spark and DuckDB as comparable rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    """A connection with the folder's tables as views."""
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def rows(names: list[str], got: list[tuple]) -> list[tuple]:
    """Rows with columns by name, in a fixed order; NaN as NULL."""
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(None if isinstance(x, float) and math.isnan(x) else x for x in (r[k] for k in order)) for r in got), key=lambda r: [(x is None, str(type(x)), x if x is not None else 0) for x in r])


def differences(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs, in words; nothing if the two agree."""
    theirs = con.execute(sql)
    names = [c[0] for c in theirs.description]
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns {sorted(spark_df.columns)} and {sorted(names)}"]
    a, b = rows(spark_df.columns, [tuple(x) for x in spark_df.collect()]), rows(names, theirs.fetchall())
    if len(a) != len(b):
        return [f"{len(a)} rows and {len(b)}"]
    off = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return [f"{len(off)} of {len(a)} rows, such as {off[0][0]} and {off[0][1]} of {sorted(names)}"] if off else []

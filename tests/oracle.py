"""Compare a query's rows with those of SQL in DuckDB."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame


def norm(v) -> str:
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def same_rows(df: DataFrame, sql: str, folder: str, tables: list[str]) -> None:
    import duckdb

    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    r = con.execute(sql)
    names = [x[0] for x in r.description]
    cols = sorted(df.columns)
    assert sorted(names) == cols
    want = sorted("|".join(norm(row[names.index(c)]) for c in cols) for row in r.fetchall())
    got = sorted("|".join(norm(row[c]) for c in cols) for row in df.collect())
    assert got == want

"""Running queries against their SQL in DuckDB."""

import math
from pathlib import Path

import duckdb

SMALL = Path("/root/testdata/sf0.001")


def database(base: Path = SMALL):
    con = duckdb.connect()
    for file in base.glob("*.parquet"):
        con.sql(f"create view {file.stem} as select * from '{file}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)) or str(value) in ("NaT", "<NA>"):
        return None
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return float(bool(value))
    if isinstance(value, (int, float)) or type(value).__module__ == "numpy" or type(value).__name__ == "Decimal":
        try:
            return round(float(value), 4)
        except (TypeError, ValueError):
            return str(value)
    return str(value)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(plain, r)) for r in frame.astype(object).itertuples(index=False)), key=str)


def check(spark, query, sql, con, base: Path = SMALL):
    ours, theirs = query(spark, str(base)).toPandas(), con.sql(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)

"""Compare a query with its DuckDB counterpart on the given tables."""

from pathlib import Path

import duckdb

SMALL = "/root/testdata/sf0.001"


def connect(sf_dir: str = SMALL) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return str(value) if hasattr(value, "isoformat") else value


def check(df, sql: str, con: duckdb.DuckDBPyConnection) -> None:
    columns = sorted(df.columns)
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    expected = sorted((tuple(plain(row[i]) for i in at) for row in found.fetchall()), key=repr)
    assert sorted((tuple(map(plain, row)) for row in df.select(*columns).collect()), key=repr) == expected

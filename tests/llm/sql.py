from pathlib import Path

import duckdb


def same_as_sql(df, sql, sf):
    """The query's rows against DuckDB's over the same tables, columns by name."""
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    names = sorted(df.columns)
    cursor = con.execute(f"select {', '.join(names)} from ({sql})")
    want = sorted(map(repr, cursor.fetchall()))
    got = sorted(repr(tuple(r[n] for n in names)) for r in df.collect())
    assert got == want

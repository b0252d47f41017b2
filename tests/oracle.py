"""Hold a query against its SQL in DuckDB: same columns, same rows whatever their order."""

from collections import Counter
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def compare(df, sql: str, sf: str) -> None:
    con = duckdb.connect()
    for p in Path(sf).iterdir():
        con.sql(f"CREATE VIEW {p.name.split('.')[0]} AS SELECT * FROM read_parquet('{p}{'/*' if p.is_dir() else ''}')")
    cols = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(f'"{c}"' for c in cols)} FROM ({sql})")
    a, b = Counter(repr(plain(tuple(r))) for r in df.select(*[df[f"`{c}`"] for c in cols]).collect()), Counter(repr(plain(r)) for r in want.fetchall())
    assert sorted(con.sql(sql).columns) == cols
    assert a == b, ((a - b).most_common(2), (b - a).most_common(2))

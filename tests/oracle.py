"""Compares a query's rows with its SQL in DuckDB, without regard to their order."""

from collections import Counter
from pathlib import Path


def same(spark, query, sql: str, folder: str) -> tuple[int, list, list]:
    import duckdb

    con = duckdb.connect()
    for f in sorted(Path(folder).iterdir()):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = query(spark, folder)
    names = sorted(df.columns)
    ours = Counter(str(tuple(r[c] for c in names)) for r in df.collect())
    cursor = con.execute(sql)
    theirs_names = [d[0] for d in cursor.description]
    assert sorted(theirs_names) == names
    at = [theirs_names.index(c) for c in names]
    theirs = Counter(str(tuple(row[i] for i in at)) for row in cursor.fetchall())
    return sum(ours.values()), list((ours - theirs))[:3], list((theirs - ours))[:3]

"""Compare a query with its SQL: rows as multisets, columns by name, doubles rounded."""

from __future__ import annotations

import decimal
from collections import Counter

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def _plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    return v


def rows_of(columns: list[str], rows: list) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def differences(frame, connection, sql: str) -> str:
    """Empty if equal; else a short account."""
    cursor = connection.execute(sql)
    columns = [d[0] for d in cursor.description]
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} against {sorted(columns)}"
    theirs = rows_of(columns, cursor.fetchall())
    ours = rows_of(frame.columns, frame.collect())
    more, less = ours - theirs, theirs - ours
    return f"{sum(ours.values())} against {sum(theirs.values())} rows; only here {list(more)[:2]}, only there {list(less)[:2]}" if more or less else ""

"""Rows of a query and of its oracle in one comparable form."""

from __future__ import annotations

import os
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x: object) -> object:
    if isinstance(x, float):
        return round(x, 6) + 0.0
    if isinstance(x, Decimal):
        return round(float(x), 6)
    return str(x) if x is not None and not isinstance(x, (int, str, bool)) else x


def comparable(names: list[str], rows: list[tuple]) -> tuple[list[str], list[str]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(repr(tuple(cell(r[i]) for i in order)) for r in rows)


def answer(sf_dir: str, sql: str) -> tuple[list[str], list[str]]:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    found = c.execute(sql)
    names = [d[0] for d in found.description]
    return comparable(names, found.fetchall())


def asked(df) -> tuple[list[str], list[str]]:
    return comparable(df.columns, [tuple(r) for r in df.collect()])

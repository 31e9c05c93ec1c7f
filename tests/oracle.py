"""Compares a query with its statement in DuckDB."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: What a column's type is called there.
KINDS = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def rows(values: list[tuple]) -> list[tuple]:
    rounded = [tuple(round(x, 9) if isinstance(x, float) and math.isfinite(x) else x for x in r) for r in values]
    return sorted(rounded, key=lambda r: tuple((x is None, str(type(x)), x) for x in r))


def compare(frame, sql: str, sf_dir: str) -> int:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    found = con.sql(sql)
    columns = sorted(frame.columns)
    assert sorted(found.columns) == columns
    assert {c: KINDS.get(str(t), str(t)) for c, t in zip(found.columns, found.types, strict=True)} == dict(frame.dtypes)
    ours = rows([tuple(r) for r in frame.select(*columns).collect()])
    theirs = rows(found.select(*[f'"{c}"' for c in columns]).fetchall())
    assert len(ours) == len(theirs)
    assert ours == theirs
    return len(ours)

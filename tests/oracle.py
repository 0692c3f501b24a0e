"""Compares a query with its SQL in DuckDB, row by row, in any order."""

import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, (bool, int, decimal.Decimal)):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.11g}")
    return v


def rows(table):
    return sorted(repr(tuple(map(_plain, r))) for r in table)


def expected(sql, sf_dir, columns):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = c.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(columns)
    at = [names.index(n) for n in columns]
    return rows([r[i] for i in at] for r in got.fetchall())

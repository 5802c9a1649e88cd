"""Comparison of a query with its SQL oracle, as multisets of rows."""

from __future__ import annotations

import glob
import os
from collections import Counter
from decimal import Decimal

import duckdb

DATA = os.environ.get("LOOMWORK_TESTDATA", "/root/testdata")


def connection(sf: str = "sf0.001"):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for path in glob.glob(f"{DATA}/{sf}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(x):
    if isinstance(x, (float, Decimal)):
        return round(float(x), 6)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


def rows(columns: list[str], data) -> Counter:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(tuple(plain(r[k]) for k in order) for r in data)


def agree(spark, query, sql: str, sf: str = "sf0.001") -> None:
    df = query(spark, f"{DATA}/{sf}")
    found = rows(df.columns, df.collect())
    out = connection(sf).sql(sql)
    wanted = rows(out.columns, out.fetchall())
    assert sorted(df.columns) == sorted(out.columns)
    assert sum(wanted.values()) > 0
    missing, extra = wanted - found, found - wanted
    assert not missing and not extra, (list(missing)[:3], list(extra)[:3], len(missing), len(extra))

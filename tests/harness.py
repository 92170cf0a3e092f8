"""Run a query and its oracle on the same tables and compare names, row counts and values."""

from __future__ import annotations

import math
import os
from decimal import Decimal

import duckdb

DATA = os.environ.get("TESSERA_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, Decimal):
        return f"{float(v):.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return str(v)


def oracle_rows(sql: str, data: str = DATA):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    rel = con.sql(sql)
    order = sorted(range(len(rel.columns)), key=lambda k: rel.columns[k])
    return [rel.columns[k] for k in order], sorted(tuple(_plain(r[k]) for k in order) for r in rel.fetchall())


def spark_rows(df):
    order = sorted(range(len(df.columns)), key=lambda k: df.columns[k])
    return [df.columns[k] for k in order], sorted(tuple(_plain(r[k]) for k in order) for r in df.collect())

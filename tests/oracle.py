"""Compares a query with its DuckDB SQL on one scale of the given tables."""

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return str(v.replace(tzinfo=None))
    return v if isinstance(v, (int, bool, type(None))) else str(v)


def assert_equal(spark, query, sql, sf_dir):
    found = query(spark, sf_dir)
    names = sorted(found.columns)
    got = [tuple(plain(r[c]) for c in names) for r in found.collect()]
    rel = connection(sf_dir).sql(sql)
    assert sorted(rel.columns) == names
    at = {c: k for k, c in enumerate(rel.columns)}
    want = [tuple(plain(r[at[c]]) for c in names) for r in rel.fetchall()]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(got, key=key) == sorted(want, key=key)

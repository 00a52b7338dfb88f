"""Spark rows against the rows of DuckDB over the same tables."""

import glob
import os
from collections import Counter
from decimal import Decimal

import duckdb


def plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    if isinstance(value, Decimal):
        return float(value)
    return value


def bag(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def spark_rows(df):
    return sorted(df.columns), bag(df.columns, df.collect())


def duckdb_rows(sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}')")
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    return sorted(columns), bag(columns, found.fetchall())

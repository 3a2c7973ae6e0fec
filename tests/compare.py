"""Comparison of a Spark result with DuckDB's, whatever the order of rows and columns."""

import glob
import math
import os

import duckdb

DATA = "/root/testdata"


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if hasattr(value, "isoformat"):
        text = value.isoformat()
        return text[:-9] if text.endswith("T00:00:00") else text
    return value


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr), sorted(names)


def check(df, con, sql):
    got, names = rows(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(sql)
    want, wanted = rows([d[0] for d in found.description], found.fetchall())
    assert names == wanted
    assert len(got) == len(want)
    assert got == want, next((a, b) for a, b in zip(got, want) if a != b)
    return len(got)

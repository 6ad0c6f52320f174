"""Spark results against DuckDB's, column by column, whatever the order of rows."""

import glob
import math
import os

import duckdb


def connect(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(p).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{p}'" if os.path.isfile(p) else f"CREATE VIEW {name} AS SELECT * FROM '{p}/*.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    out = [tuple(plain(r[k]) for k in order) for r in values]
    return [columns[k] for k in order], sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def same(spark_df, con, sql):
    cur = con.execute(sql)
    want = rows([d[0] for d in cur.description], cur.fetchall())
    got = rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1], strict=True):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-6)) for x, y in zip(a, b, strict=True)), (a, b)
    return len(got[1])

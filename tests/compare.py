"""A query's rows beside those of its SQL in DuckDB."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def _cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return ""
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return f"{float(x):.6g}" if abs(float(x)) > 1e-9 else "0"
    if hasattr(x, "isoformat"):
        return x.isoformat(" ")[:19] if hasattr(x, "hour") else x.isoformat()
    return str(x)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in data)


def differences(spark, query, sql, sf_dir):
    """None if equal, else a few rows of either side only."""
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    con = duck(sf_dir)
    cur = con.execute(sql)
    want = rows([d[0] for d in cur.description], cur.fetchall())
    if got == want:
        return None
    a, b = set(got[1]), set(want[1])
    return {"columns": (got[0], want[0]), "rows": (len(got[1]), len(want[1])), "spark only": sorted(a - b)[:4], "sql only": sorted(b - a)[:4]}

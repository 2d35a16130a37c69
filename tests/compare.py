"""Runs the catalogue's queries beside their SQL and compares the rows."""

import datetime
import decimal
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if isinstance(x, float):
        return "nan" if x != x else float(f"{x:.12g}")
    if isinstance(x, decimal.Decimal):
        return value(float(x)) if x != int(x) else int(x)
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    return float(f"{x:.12g}") if isinstance(x, int) and abs(x) < 2**53 else x


def spark_rows(df):
    names = sorted(df.columns)
    return names, Counter(tuple(value(r[c]) for c in names) for r in df.collect())


def duck_rows(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(p := f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], Counter(tuple(value(r[k]) for k in order) for r in cur.fetchall())

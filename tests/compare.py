"""Results of Spark and of DuckDB as comparable multisets of rows, columns by name."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, decimal.Decimal):
        return plain(float(x))
    if isinstance(x, int) and not isinstance(x, bool):
        return x
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in sorted(x.items()))
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), Counter(tuple(plain(r[i]) for i in order) for r in rows)


def duck(sf_dir, sql):
    con = duckdb.connect()
    con.execute("SET threads = 2")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = con.execute(sql)
    return rows_of([d[0] for d in got.description], got.fetchall())


def check(spark, sf_dir, run, sql):
    df = run(spark, sf_dir)
    names, found = rows_of(df.columns, df.collect())
    want_names, want = duck(sf_dir, sql)
    assert names == want_names
    assert found == want, f"only in Spark: {list((found - want).items())[:5]}; only in SQL: {list((want - found).items())[:5]}"
    return sum(found.values())

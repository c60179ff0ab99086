"""Runs a driver query and its SQL over the same tables and compares the rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v):
    return round(v, 6) if isinstance(v, float) else tuple(map(shown, v)) if isinstance(v, (list, tuple)) else v


def same(spark, sf_dir, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    rel = con.sql(sql)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    mine = sorted((tuple(shown(r[c]) for c in cols) for r in df.collect()), key=key)
    theirs = sorted((tuple(shown(r[i]) for i in at) for r in rel.fetchall()), key=key)
    assert mine == theirs

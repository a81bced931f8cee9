"""Runs a registered query and its SQL on the same tables and compares rows, as sorted text."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    con.execute("SET TimeZone='UTC'")
    return con


def plain(v):
    if isinstance(v, float):
        return "NaN" if v != v else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def compare(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    rel = connect(sf_dir).execute(sql)
    have = [c[0] for c in rel.description]
    assert sorted(have) == names, (sorted(have), names)
    order = [have.index(c) for c in names]
    want = sorted(tuple(plain(r[i]) for i in order) for r in rel.fetchall())
    assert len(got) == len(want), (len(got), len(want))
    for a, b in zip(got, want):
        assert a == b, f"{names}\n got {a}\nwant {b}"
    return len(got)

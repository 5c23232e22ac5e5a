"""Holds a Spark result against DuckDB SQL over the same tables: names, row count and values in any order."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(float(v[i])) if isinstance(v[i], float) else repr(v[i]) for i in order) for v in values)


def same(df, sql, con):
    con.execute(sql)
    names, values = [d[0] for d in con.description], con.fetchall()
    got = [tuple(r) for r in df.collect()]
    assert sorted(df.columns) == sorted(names)
    a, b = rows(df.columns, got), rows(names, values)
    assert len(a) == len(b)
    odd = [x for x in zip(a, b, strict=True) if x[0] != x[1]]
    assert not odd, odd[:3]
    return len(a)

"""Runs a query's SQL in DuckDB over the same tables and compares rows."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def expected(sf_dir, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    rel = con.sql(sql)
    return rel.columns, rel.fetchall()


def plain(v):
    return None if isinstance(v, float) and v != v else round(v, 6) if isinstance(v, float) else v


def rows(columns, data):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def same(df, sf_dir, sql):
    columns, data = expected(sf_dir, sql)
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, data)

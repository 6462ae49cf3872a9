"""Compares a Spark result with its DuckDB SQL, as bags of rows with columns in order of name."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return None if v != v else round(v, 9)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    return v


def bag(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def assert_equal(df, sql, con):
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    assert bag(df.columns, df.collect()) == bag(list(rel.columns), rel.fetchall())

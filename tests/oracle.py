"""Runs a query on Spark and its SQL on DuckDB and compares the rows."""

import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, int):
        return v
    return None if v != v else round(float(v), 6)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, query, sql):
    df, other = query(spark, sf_dir), con.sql(sql)
    assert sorted(df.columns) == sorted(other.columns)
    found, wanted = rows_of(df.columns, df.collect()), rows_of(other.columns, other.fetchall())
    assert len(found) == len(wanted)
    assert found == wanted

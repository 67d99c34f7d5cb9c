"""Rows of a Spark query against those of its SQL in DuckDB."""

import glob
import math

import duckdb


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def same_rows(spark, sf_dir, query, sql):
    duck = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = path.rsplit("/", 1)[1].removesuffix(".parquet")
        duck.execute(f"create view {name} as select * from '{path}'")
    df, found = query(spark, sf_dir), duck.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    order = [found.columns.index(c) for c in columns]
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    theirs = sorted((tuple(plain(r[k]) for k in order) for r in found.fetchall()), key=str)
    assert ours == theirs
    return len(ours)

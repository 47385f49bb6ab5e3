"""Runs a query and its SQL over one directory of tables and compares the rows."""

import glob
import os

import duckdb


def rows(df):
    names = sorted(df.columns)
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr), names


def sql_rows(sf_dir, sql):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p)[: -len(".parquet")]
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    rel = con.sql(sql)
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    return sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=repr), sorted(rel.columns)

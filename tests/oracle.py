"""Compares a query's rows with those of its SQL, without regard to order."""

import math

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(x):
    if isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, float) and x == 0:
        return 0.0
    return x


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(_cell(r[c]) for c in cols) for r in df.collect()), key=repr)


def rows_of_sql(con, sql):
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    return cols, sorted((tuple(_cell(r[i]) for i in at) for r in cur.fetchall()), key=repr)

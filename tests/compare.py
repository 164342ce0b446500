"""Order-free comparison of a Spark result with a DuckDB result."""

import os

import duckdb

TABLES = ("documents", "labels", "embeddings", "benchmark", "pages", "conversations")


def duck(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{os.path.join(folder, name)}.parquet'")
    return con


def _key(row):
    return tuple((v is None, str(type(v).__name__) if isinstance(v, str) else "", v if v is not None else 0) for v in row)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(round(r[i], 6) + 0.0 if isinstance(r[i], float) else r[i] for i in order) for r in rows]
    return [columns[i] for i in order], sorted(plain, key=_key)


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    cursor = con.execute(sql)
    return rows_of([d[0] for d in cursor.description], cursor.fetchall())

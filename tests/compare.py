"""Rows of a Spark query and of its DuckDB SQL, made comparable."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.11g}"
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    return str(v)


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())


def duck_rows(sql, sf_dir):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.sql(sql)
    order = sorted(range(len(found.columns)), key=lambda i: found.columns[i])
    return [found.columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in found.fetchall())

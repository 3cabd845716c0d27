"""The rows of a query by DuckDB, over a folder of tables or Spark tables."""

import glob
import os

import duckdb


def rows(sql, sf_dir, columns, **tables):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        if (name := os.path.basename(path)[:-8]) not in tables:
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    for name, df in tables.items():
        con.register(name, df.toArrow())
    return sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall(), key=str)


def spark_rows(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)

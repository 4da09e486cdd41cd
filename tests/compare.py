"""Run a query in Spark and its SQL in DuckDB on the same tables and compare the rows."""

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(df, columns):
    plain = lambda v: None if v is None or v is pd.NaT or v != v else str(pd.Timestamp(v)) if isinstance(v, pd.Timestamp) else v
    return sorted((tuple(plain(v) for v in r) for r in df[columns].itertuples(index=False)), key=repr)


def same(spark_df, duck_df):
    assert sorted(spark_df.columns) == sorted(duck_df.columns)
    columns = sorted(spark_df.columns)
    assert rows(spark_df, columns) == rows(duck_df, columns)

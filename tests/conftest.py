import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def compare(spark, name: str, query, sql: str, sf_dir: str = SF) -> None:
    """Rows of a query and of its SQL in DuckDB, without order."""
    import glob

    import duckdb
    import pandas as pd

    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    got, want = query(spark, sf_dir).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns), name

    def rows(df):
        def plain(v):
            return "null" if v is None or pd.isna(v) else repr(float(v)) if isinstance(v, float) and v != int(v) else str(int(v)) if isinstance(v, float) else str(v)

        return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))

    assert rows(got) == rows(want), name

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


def plain(v):
    if v is None:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool) or not isinstance(v, (int, float, str)):
        return str(v)
    return round(float(v), 6) if isinstance(v, float) else v


@pytest.fixture(scope="session")
def same_rows(duck, spark, sf):
    """Runs a query and its SQL and compares columns and rows."""

    def check(query, sql):
        df = query(spark, sf)
        result = duck.sql(sql)
        assert sorted(df.columns) == sorted(result.columns)
        mine = sorted(df.columns)
        got = sorted(repr([plain(r[c]) for c in mine]) for r in df.collect())
        at = [result.columns.index(c) for c in mine]
        assert got == sorted(repr([plain(r[i]) for i in at]) for r in result.fetchall())

    return check

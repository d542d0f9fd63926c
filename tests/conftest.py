import os
import sys
import tempfile

import duckdb
import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    where = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.local.dir", where)
        .config("spark.sql.warehouse.dir", f"{where}/warehouse")
        .config("spark.checkpoint.dir", f"{where}/shared")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def cell(v):
    """Whole numbers are equal as integers and as doubles: a column of integers with nulls comes as either."""
    if v is None or v is pd.NA or v != v:
        return None
    if isinstance(v, float):
        return str(int(v)) if v.is_integer() else round(float(v), 6)
    return str(v)


def normal(df):
    """Rows as sorted tuples of comparable values, columns by name."""
    df = df[sorted(df.columns)]
    return sorted((tuple(map(cell, row)) for row in df.itertuples(index=False)), key=str)


@pytest.fixture(scope="session")
def same_rows():
    def compare(got, want):
        assert sorted(got.columns) == sorted(want.columns)
        assert normal(got) == normal(want)

    return compare

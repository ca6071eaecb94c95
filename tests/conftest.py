import os

import duckdb
import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    return duck_at(SF)


def duck_at(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def norm(value):
    if value is None or str(value) in ("NaT", "<NA>", "nan"):
        return "null"
    return f"{value:.9g}" if isinstance(value, float) else str(value)


def same_rows(spark_df, duck_df):
    """Compare as multisets of rows, columns by name."""
    left = spark_df.toPandas()
    columns = sorted(left.columns)
    assert sorted(duck_df.columns) == columns
    rows = lambda d: sorted(tuple(map(norm, r)) for r in d[columns].itertuples(index=False))
    a, b = rows(left), rows(duck_df)
    assert len(a) == len(b)
    assert a == b



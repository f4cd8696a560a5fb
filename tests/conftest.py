import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.log.level", "ERROR").getOrCreate()
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.fixture(scope="session")
def same_rows(spark, duck):
    """Whether a query gives the rows of its SQL, whatever their order."""

    def check(query, sql):
        a, b = query(spark, SF).toPandas(), duck.execute(sql).df()
        assert sorted(a.columns) == sorted(b.columns)
        names = sorted(a.columns)
        rows = lambda x: sorted(map(tuple, x[names].astype(str).values.tolist()))
        assert rows(a) == rows(b)

    return check

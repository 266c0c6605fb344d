import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def normal(value):
    import math

    if value is None or str(value) in ("<NA>", "NaT"):
        return "null"
    if isinstance(value, float):
        return "null" if math.isnan(value) else repr(round(value, 6)).removesuffix(".0")
    return str(value)


@pytest.fixture(scope="session")
def same():
    """Compares a DataFrame with what DuckDB gives: the same columns, and the same bag of rows."""

    def check(df, duck, sql):
        ours, theirs = df.toPandas(), duck.sql(sql).df()
        columns = sorted(theirs.columns)
        assert columns == sorted(ours.columns)
        bag = lambda f: sorted(tuple(map(normal, r)) for r in f[columns].itertuples(index=False))
        assert bag(ours) == bag(theirs)

    return check

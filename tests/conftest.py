import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "2").config("spark.sql.codegen.wholeStage", "false").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.default.parallelism", "4").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def rows(spark):
    """rows([...], schema) -> DataFrame"""
    return lambda data, schema: spark.createDataFrame(data, schema)


def oracle(sql: str, folder: str = DATA):
    """Rows of a query in DuckDB over the tables of a folder."""
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(folder):
        c.execute(f"CREATE VIEW {f.partition('.')[0]} AS SELECT * FROM read_parquet('{folder}/{f}')")
    rel = c.execute(sql)
    names = [x[0] for x in rel.description]
    return names, rel.fetchall()


def same(df, sql: str) -> None:
    from collections import Counter

    text = lambda v: str(round(v, 9)) if isinstance(v, float) else str(v)
    names, expected = oracle(sql)
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in df.columns]
    got = Counter(tuple(map(text, r)) for r in df.collect())
    assert got == Counter(tuple(text(r[i]) for i in at) for r in expected)

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def compare(spark, small):
    """Check a query of the catalogue against its DuckDB SQL on the smallest tables."""
    import glob

    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")

    def plain(v):
        if v is None or v != v:
            return None
        if isinstance(v, float):
            return round(v, 5) + 0.0
        return v

    def rows(columns, data):
        order = sorted(range(len(columns)), key=columns.__getitem__)
        return sorted(repr([plain(r[i]) for i in order]) for r in data)

    def check(run, sql):
        got = run(spark, small)
        want = con.sql(sql)
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())

    return check

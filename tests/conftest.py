import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def oracle(sf_dir):
    """Rows of a SQL text in DuckDB over the same tables, columns sorted by name."""
    import glob

    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")

    def rows(sql: str):
        columns = sorted(con.sql(sql).columns)
        quoted = ", ".join(f'"{c}"' for c in columns)
        return columns, sorted(map(repr, con.sql(f"SELECT {quoted} FROM ({sql})").fetchall()))

    return rows


@pytest.fixture
def same(oracle):
    def check(df, sql: str) -> None:
        columns, expected = oracle(sql)
        assert sorted(df.columns) == columns
        assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == expected

    return check

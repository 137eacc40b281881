"""Session helpers."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


#: Bytes and rows of an Arrow batch between the JVM and Python, where the session does not
#: say otherwise.  Texts are long: Spark's own bounds let a batch grow to a worker's size.
ARROW = {"spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20, "spark.sql.execution.arrow.maxRecordsPerBatch": 4096}


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers that start from now on find this package where it is
    not installed: its folder joins their path.  Arrow batches are bounded too."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    for name, most in ARROW.items():
        if spark.conf.get(name) == _default(spark, name):
            spark.conf.set(name, str(most))
    return spark


def _default(spark: SparkSession, name: str) -> str:
    """The value that a setting has where nobody sets it."""
    conf = spark._jvm.org.apache.spark.sql.internal.SQLConf
    return conf().getConfString(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")

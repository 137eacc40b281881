"""Tables of vectors as Parquet with a JSON manifest.

The manifest holds the parameters and a checksum of the rows (the sum of each
row's CRC-32, so it does not depend on order); loading compares it.  Indexes save and
load themselves through these functions."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checksum(df: DataFrame) -> int:
    rows = df.select(F.crc32(F.to_json(F.struct(*sorted(df.columns))).cast("binary")).alias("c"))
    return int(rows.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])


#: Rows of a file of a clustered table, about.
FILE_ROWS = 1 << 20


def clustered(df: DataFrame, by: str, sizes: dict[int, int]) -> DataFrame:
    """``df`` dealt and sorted by a column of small numbers, of whose values ``sizes``
    tells the rows: a value's rows lie together, those of a large one in several tasks."""
    deal = F.create_map(*[F.lit(x) for value, n in sizes.items() for x in (value, -(-n // FILE_ROWS))]) if sizes else None
    salt = F.pmod(F.xxhash64("id"), deal[F.col(by)]) if deal is not None else F.lit(0)
    return df.repartition(by, salt).sortWithinPartitions(by)


def save_table(df: DataFrame, path: str, *, partition_by: str | None = None, meta: dict | None = None) -> None:
    """Write ``df`` below ``path``, partitioned by a column if given (see :func:`clustered`)."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{path}/rows")
    spark = df.sparkSession
    stored = spark.read.parquet(f"{path}/rows")
    manifest = json.dumps({"meta": meta or {}, "columns": sorted(df.columns), "crc32_sum": checksum(stored.select(*df.columns))})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load_table(spark: SparkSession, path: str, *, verify: bool = True, kind: str | None = None) -> tuple[DataFrame, dict]:
    """Rows and parameters of a saved table; raises where the checksum or the kind of
    index is another."""
    manifest = json.loads(spark.read.option("wholetext", True).text(f"{path}/manifest").first()[0])
    if kind is not None and manifest["meta"].get("kind") != kind:
        raise ValueError(f"{path} holds no index of kind {kind!r}")
    df = spark.read.parquet(f"{path}/rows")
    if verify and checksum(df.select(*manifest["columns"])) != manifest["crc32_sum"]:
        raise ValueError(f"checksum of {path} does not match its manifest")
    return df, manifest["meta"]

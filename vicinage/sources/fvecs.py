"""Reader of ``.fvecs`` files: records of a little-endian int32 length and as many float32."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files whose first ids are broadcast; beyond it they are joined by shuffle.
BROADCAST_FILES = 100_000


def parse(content: bytes) -> np.ndarray:
    if not content:
        return np.empty((0, 0), np.float32)
    dim = int(np.frombuffer(content, "<i4", 1)[0])
    if dim <= 0 or len(content) % (4 * (dim + 1)):
        raise ValueError("not an fvecs file, or records of different lengths")
    table = np.frombuffer(content, "<f4").reshape(-1, dim + 1)
    if (np.frombuffer(content, "<i4").reshape(-1, dim + 1)[:, 0] != dim).any():
        raise ValueError("records of different lengths")
    return table[:, 1:]


def read_fvecs(spark: SparkSession, path: str) -> DataFrame:
    """``file, position, vec``; a file is one task's work, positions count from 0 in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            for name, content in zip(files.column(0), files.column(1), strict=True):
                rows = parse(content.as_py())
                for at in range(0, len(rows), 4096):
                    some = rows[at : at + 4096]
                    n = len(some)
                    vec = pa.ListArray.from_arrays(pa.array(np.arange(0, n * some.shape[1] + 1, some.shape[1]), pa.int32()), pa.array(some.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * n), pa.array(np.arange(at, at + n), pa.int64()), vec], names=["file", "position", "vec"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, position long, vec array<float>")


def with_ids(vectors: DataFrame) -> DataFrame:
    """``id, vec``: ids count on from file to file in the order of their names.  One
    row a file reaches the driver; they are broadcast up to ``BROADCAST_FILES``."""
    counts = vectors.groupBy("file").agg(F.count("*").alias("n"))
    starts = {}
    total = 0
    for r in counts.orderBy("file").collect():  # one row a file
        starts[r["file"]] = total
        total += r["n"]
    offsets = vectors.sparkSession.createDataFrame(list(starts.items()) or [("", 0)], "file string, start long")
    offsets = F.broadcast(offsets) if len(starts) <= BROADCAST_FILES else offsets
    return vectors.join(offsets, "file").select((F.col("start") + F.col("position")).alias("id"), "vec")

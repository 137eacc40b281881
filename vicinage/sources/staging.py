"""Tables that a job writes for itself in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir`` of the
    session, or the checkpoint folder of its context.  Where both are unset, a session
    on one machine (tests, a notebook) gets a folder of that machine as its checkpoint
    folder; on a cluster that raises, since executors would not see each other's files."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="vicinage-"))
        current = context._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; removed when the driver ends."""
    path = f"{shared_dir(spark)}/vicinage-{label}-{uuid.uuid4().hex}"
    atexit.register(drop_path, spark, path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete ``path`` through Hadoop's file system, whatever store holds it."""
    try:
        jvm = spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        return


class Staged:
    """A written table in the shared folder: cuts lineage, and survives lost
    executors because no executor's own disk holds it.  ``drop`` deletes it as soon as
    nothing reads it any more; what is left goes when the driver ends."""

    def __init__(self, df: DataFrame, label: str, *, partition_by: str | None = None):
        self._spark = df.sparkSession
        self.path = fresh_path(self._spark, label)
        (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(self.path)
        self.df = self._spark.read.parquet(self.path)

    def drop(self) -> None:
        drop_path(self._spark, self.path)

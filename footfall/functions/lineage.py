"""The folder that all executors share: tables whose lineage is cut, and files that a job writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_base(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, without a slash at its end.

    Only a session that runs in one process (tests) may leave it unset and gets a temporary one of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="footfall-"))
    return _LOCAL[0]


def cut(table: DataFrame) -> DataFrame:
    """The table as worked out now: a checkpoint in the shared folder, which outlives any executor."""
    context = table.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(f"{shared_base(table.sparkSession)}/footfall-checkpoints")
    return table.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path below the shared one; it goes when the driver ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_base(spark)}/footfall-files-{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()

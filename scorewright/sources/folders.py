"""The folder that the driver and all executors share, for tables and files that a job leaves to itself."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL: dict[str, str] = {}


def place(spark: SparkSession, path: str):
    """Hadoop's file system and path."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir or set as checkpoint directory; in local mode alone, else a folder of this process."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="scorewright-")
    return _LOCAL[app]


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, deleted when the application ends."""
    path = f"{shared_folder(spark)}/scorewright/{name}-{uuid.uuid4().hex}"
    files, target = place(spark, path)
    files.deleteOnExit(target)
    return path

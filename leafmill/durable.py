"""Tables cut from their lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder of our own only on ``local`` masters that set none."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _LOCAL:
        _LOCAL[key] = "file://" + tempfile.mkdtemp(prefix="leafmill-")
    return _LOCAL[key]


def _file(spark: SparkSession, path: str):
    """The Hadoop path and its file system; Spark has no public API that deletes files."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def work_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted when the driver ends, unless it is dropped before."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    where, fs = _file(spark, path)
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def cut(df: DataFrame, tag: str = "step") -> tuple[DataFrame, str]:
    """Write ``df`` as a table in the shared folder and read it again. The path goes to :func:`drop` when it is over; what a
    result still reads stays until the driver ends. The shuffle files of the write go when it ends, not at some later collection."""
    spark = df.sparkSession
    path, before = work_path(spark, tag), spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str | None) -> None:
    """Delete a table made by :func:`cut`."""
    if path:
        where, fs = _file(spark, path)
        fs.delete(where, True)
        fs.cancelDeleteOnExit(where)

"""The folder that driver and executors share, and tables written there to cut a lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_roots: dict[tuple[str, str], str] = {}


def _fs(spark: SparkSession, path: str):
    """Hadoop's path and its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own for a local master, and an error for a cluster."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="causalframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, below one folder of the application that its end removes."""
    shared = shared_dir(spark)
    at = (spark.sparkContext.applicationId, shared)
    if at not in _roots:
        _roots[at] = f"{shared}/causalframe-{uuid.uuid4().hex}"
        p, fs = _fs(spark, _roots[at])
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    return f"{_roots[at]}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written as Parquet in the shared folder and read again: a lost executor costs nothing that came before."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a path that scratch() gave, through Hadoop's file systems."""
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def swap(spark: SparkSession, new: str, path: str) -> None:
    """Move a complete folder to `path`; what stood there is moved aside first and then removed."""
    p, fs = _fs(spark, path)
    old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.old-{uuid.uuid4().hex}")
    there = fs.exists(p)
    if there and not fs.rename(p, old):
        raise OSError(f"{path} could not be moved aside")
    if not fs.rename(_fs(spark, new)[0], p):
        raise OSError(f"{new} could not be moved to {path}")
    if there:
        fs.delete(old, True)

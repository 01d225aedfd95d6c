"""Tables in the folder that all executors share: lineage ends in them, and lost executors cost nothing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only on a local master without it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        _own[app] = "file://" + tempfile.mkdtemp(prefix="rowloom-")
    return _own[app]


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/rowloom/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder and read from there."""
    path = new_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(spark: SparkSession, path: str):
    """(file system, path) of Hadoop's API, which knows object stores as well as mounted folders."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def folders(spark: SparkSession, path: str) -> dict[str, float]:
    """The folders under a path and the time, in seconds since 1970, when each was last written to."""
    fs, p = filesystem(spark, path)
    if not fs.exists(p):
        return {}
    return {s.getPath().getName(): s.getModificationTime() / 1000 for s in fs.listStatus(p) if s.isDirectory()}


def delete(spark: SparkSession, path: str) -> None:
    fs, p = filesystem(spark, path)
    fs.delete(p, True)

"""Tables, the shared folder, and files in it that Python code reads and writes itself."""

from __future__ import annotations

import atexit
import os
import shutil
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where that is unset, a folder of
    this machine's own is taken if the session runs on this machine alone; on a cluster that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        context = spark.sparkContext
        if not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = f"{spark.conf.get('spark.local.dir', '/tmp')}/loomwork-{context.applicationId}"
        context.setCheckpointDir(where)
        atexit.register(shutil.rmtree, where, ignore_errors=True)
    return where.rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing else uses. What is put there goes when the session ends."""
    path = f"{shared_dir(spark)}/loomwork-{what}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def drop(spark: SparkSession, *paths: str) -> None:
    """Deletes folders of the shared storage that nothing will read again."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows by way of a Parquet table in the shared folder; cuts the lineage."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.loomwork_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes what ``written`` has written, once no plan needs it any more."""
    for df in tables:
        if path := getattr(df, "loomwork_path", None):
            drop(df.sparkSession, path)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it: a mounted folder, or any that Arrow knows
    (``hdfs:``, ``s3:``, ``gs:``, ``abfs:``). Others raise, and so does a path that isn't absolute."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if path.startswith("s3a://") or path.startswith("s3n://"):
        path = "s3://" + path[6:]
    if "://" not in path and not os.path.isabs(path):
        raise ValueError(f"not an absolute path: {path}")
    return fs.FileSystem.from_uri(path)


def put(path: str, data) -> None:
    """Writes a file whole: under a name of its own first, then renamed."""
    where, at = opened(path)
    mine = f"{at}.{uuid.uuid4().hex}.part"
    with where.open_output_stream(mine) as out:
        out.write(data)
    where.move(mine, at)

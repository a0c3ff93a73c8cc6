"""Intermediate tables in the folder that all executors share.

An application has one folder below ``spark.checkpoint.dir``, which goes when its driver ends; a run that
knows when it is done (a micro-batch, a written result) deletes its own part of it at once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_top(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset, as in tests, a local session gets one of its own; on a
    cluster, where machines don't share their disks, that is an error."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", top)
    return top.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own, own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def run_folder(spark: SparkSession) -> str:
    """A new path in the application's folder."""
    top = f"{shared_top(spark)}/tarja-{spark.sparkContext.applicationId}"
    path, files = _file_system(spark, top)
    files.mkdirs(path)
    files.deleteOnExit(path)
    return f"{top}/{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    own, files = _file_system(spark, path)
    return files.exists(own)


def put_file(spark: SparkSession, path: str, value: str) -> None:
    """A small file that is there as a whole or not at all: written beside and then renamed."""
    own, files = _file_system(spark, path)
    beside, _ = _file_system(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = files.create(beside)
    out.write(bytearray(value.encode()))
    out.close()
    if not files.rename(beside, own):
        files.delete(beside, False)


def folders_in(spark: SparkSession, path: str) -> list[str]:
    own, files = _file_system(spark, path)
    return [str(f.getPath().getName()) for f in files.listStatus(own) if f.isDirectory()] if files.exists(own) else []


def delete_folder(spark: SparkSession, folder: str) -> None:
    path, files = _file_system(spark, folder)
    files.delete(path, True)


def written(df: DataFrame, folder: str, name: str | None = None) -> DataFrame:
    """``df`` as a table in ``folder``: what follows reads it instead of computing it
    again, also after executors are lost."""
    path = f"{folder}/{name or uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

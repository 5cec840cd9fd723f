"""A folder that driver and executors share, for files that a query writes and reads again."""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset a local session gets a temporary one; a cluster must name a shared one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if root is None:
            if sc.master.split("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            root = tempfile.mkdtemp(prefix="siftworks-")
        sc.setCheckpointDir(root)
    return sc.getCheckpointDir()


def folder(spark: SparkSession, name: str) -> str:
    """A new path below checkpoint_dir()."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, so that lost executors cost no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    at, fs = _path(spark, path)
    fs.delete(at, True)


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _path(spark, path)
    return fs.exists(at)


def rename(spark: SparkSession, path: str, to: str) -> None:
    at, fs = _path(spark, path)
    fs.rename(at, _path(spark, to)[0])


def copy(spark: SparkSession, path: str, to: str) -> None:
    at, fs = _path(spark, path)
    to_at, to_fs = _path(spark, to)
    spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, at, to_fs, to_at, False, spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file of the driver's, such as a manifest; what was there is replaced."""
    at, fs = _path(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    at, fs = _path(spark, path)
    source = fs.open(at)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none where it is not there."""
    at, fs = _path(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Makes the file unless it is there; of several writers one succeeds, and no reader sees half a file.

    Local files are linked from a finished one. Stores such as HDFS refuse to create a file twice.
    """
    at, fs = _path(spark, path)
    fs.mkdirs(at.getParent())
    if fs.getScheme() == "file":
        source = f"{path}.{uuid.uuid4().hex}"
        write_text(spark, source, text)
        local = lambda p: urlparse(p).path if p.startswith("file:") else p
        try:
            os.link(local(source), local(path))
        except FileExistsError:
            return False
        finally:
            fs.delete(_path(spark, source)[0], False)
        return True
    try:
        out = fs.create(at, False)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception):
            return False
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True

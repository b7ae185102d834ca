"""Small files and folders of a store, through the file system that Spark reads and writes them with."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; on a local master a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = os.path.join(tempfile.gettempdir(), f"leadloom-{os.getpid()}")
    return found.rstrip("/")


def _opened(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds, in order; nothing where there is none."""
    at, system = _opened(spark, path)
    return sorted(f.getPath().getName() for f in system.listStatus(at)) if system.exists(at) else []


def created(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a new small file; False, and nothing is written, if there is one."""
    at, system = _opened(spark, path)
    if system.exists(at):
        return False
    try:
        out = system.create(at, False)
    except Exception:
        if system.exists(at):  # another writer was first
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def text_of(spark: SparkSession, path: str) -> str:
    at, system = _opened(spark, path)
    stream = system.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def removed(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        at, system = _opened(spark, p)
        system.delete(at, True)

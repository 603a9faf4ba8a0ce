"""Small file operations of the driver, through the file system of the path."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _open(spark, path)
    return system.exists(target)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a folder; empty when it does not exist."""
    system, target = _open(spark, path)
    if not system.exists(target):
        return []
    return sorted(status.getPath().getName() for status in system.listStatus(target))


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file unless it exists. False means another writer was first."""
    system, target = _open(spark, path)
    try:
        out = system.create(target, False)
    except Exception as error:
        if system.exists(target):
            return False
        raise error
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def remove(spark: SparkSession, path: str) -> None:
    """Remove a file, or a folder with all it holds, if it exists."""
    system, target = _open(spark, path)
    system.delete(target, True)

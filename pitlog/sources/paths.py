"""File checks through Hadoop's file system API, so that any storage Spark reads works."""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def committed(spark: SparkSession, path: str) -> bool:
    """Whether a Spark write to ``path`` finished."""
    return exists(spark, f"{path.rstrip('/')}/_SUCCESS")


def listing(spark: SparkSession, path: str) -> dict[str, str]:
    """For each folder directly under ``path`` a mark of its files: names, lengths and times.

    Only the store's listing is read. Files whose names begin with "_" or "." do not count.
    """
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return {}
    out = {}
    for status in fs.listStatus(p):
        if status.isDirectory() and not status.getPath().getName().startswith(("_", ".")):
            files, marks = fs.listFiles(status.getPath(), True), []
            while files.hasNext():
                f = files.next()
                name = f.getPath().getName()
                if not name.startswith(("_", ".")):
                    marks.append(f"{name}:{f.getLen()}:{f.getModificationTime()}")
            out[status.getPath().getName()] = hashlib.sha256("\n".join(sorted(marks)).encode()).hexdigest()
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete one of this library's own tables."""
    fs, p = _fs(spark, path)
    fs.delete(p, True)

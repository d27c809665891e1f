"""File system helpers, by way of the session's own Hadoop file system."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path_and_fs(spark: SparkSession, path: str):
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(
        spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    hadoop_path, fs = _path_and_fs(spark, path)
    return fs.exists(hadoop_path)


def is_file(spark: SparkSession, path: str) -> bool:
    hadoop_path, fs = _path_and_fs(spark, path)
    return fs.exists(hadoop_path) and fs.getFileStatus(hadoop_path).isFile()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder that this package wrote itself; nothing happens without one."""
    hadoop_path, fs = _path_and_fs(spark, path)
    fs.delete(hadoop_path, True)


def listing(spark: SparkSession, path: str) -> list[tuple[str, str, bool]]:
    """``(name, full path, is_file)`` of the direct children, sorted by name."""
    hadoop_path, fs = _path_and_fs(spark, path)
    if not fs.exists(hadoop_path):
        return []
    return sorted(
        (s.getPath().getName(), s.getPath().toString(), s.isFile())
        for s in fs.listStatus(hadoop_path)
    )


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file that is there whole or not at all; an older one is replaced."""
    hadoop_path, fs = _path_and_fs(spark, path)
    part, _ = _path_and_fs(spark, f"{path}.part")
    stream = fs.create(part, True)
    try:
        stream.write(text.encode())
    finally:
        stream.close()
    fs.delete(hadoop_path, False)
    if not fs.rename(part, hadoop_path):
        raise OSError(f"cannot write {path}")


def read_text(spark: SparkSession, path: str) -> str:
    hadoop_path, fs = _path_and_fs(spark, path)
    stream = fs.open(hadoop_path)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()

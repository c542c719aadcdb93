"""Small text files in shared storage that change in one step: pointers to the current version, manifests."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def read(spark: SparkSession, path: str) -> str | None:
    """The text of a small file; None if there is none."""
    where, files = _path(spark, path)
    if not files.exists(where):
        return None
    stream = files.open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def replace(spark: SparkSession, path: str, text: str) -> None:
    """Writes a file beside and renames it over the old one: readers see the old text or the new one, never a part."""
    where, files = _path(spark, path)
    files.mkdirs(where.getParent())
    beside, _ = _path(spark, f"{path}.{uuid.uuid4().hex}")
    stream = files.create(beside, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    rename = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(files.makeQualified(beside), files.makeQualified(where), how)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    where, files = _path(spark, path)
    return sorted(x.getPath().getName() for x in files.listStatus(where)) if files.exists(where) else []


def remove(spark: SparkSession, path: str) -> None:
    where, files = _path(spark, path)
    files.delete(where, True)

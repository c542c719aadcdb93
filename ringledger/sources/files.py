"""Text sources and sinks below shared storage, with declared schemas; nothing is inferred from data."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, a default in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file:///tmp/checkpoints/ringledger"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """`df` written as parquet into shared storage and read back."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_csv(df: DataFrame, path: str | None = None, mode: str = "error") -> str:
    path = path or scratch(df.sparkSession)
    df.write.mode(mode).csv(path, header=True)
    return path


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def read_csv_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """An optional file: no rows if it isn't there."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return read_csv(spark, path, schema) if there else spark.createDataFrame([], schema)


def write_json(df: DataFrame, path: str | None = None, mode: str = "error") -> str:
    path = path or scratch(df.sparkSession)
    df.write.mode(mode).json(path)
    return path


def read_json(spark: SparkSession, path: str, schema: T.StructType, whole_file: bool = False) -> DataFrame:
    """JSON lines, or with whole_file one document (an array of objects) a file."""
    return spark.read.schema(schema).json(path, multiLine=whole_file)


def write_text(df: DataFrame, path: str | None = None, mode: str = "error") -> str:
    """One string column, a line a row."""
    path = path or scratch(df.sparkSession)
    df.write.mode(mode).text(path)
    return path


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def jdbc(spark: SparkSession, url: str, query: str, column: str | None = None, bounds: tuple[int, int] = (0, 0), partitions: int = 1, **options: str) -> DataFrame:
    """A query of another database; with a numeric column, read in that many ranges side by side."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if column is None:
        return reader.option("query", query).load()
    ranged = {"dbtable": f"({query}) q", "partitionColumn": column, "lowerBound": bounds[0], "upperBound": bounds[1], "numPartitions": partitions}
    return reader.options(**ranged).load()


def columns_of(df: DataFrame) -> DataFrame:
    """name and kind of each column, as a catalog would list them."""
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema], "name string, kind string")

"""What the training-data operators share: tables, sizes, shared storage, bundles of rows and array helpers.

Bundles. Several operators must ask, for every distinct key in a text (an anchor, a word), something about all texts.
Rows are dealt into bundles of a few megabytes by a hash of their id and text, so that rows without an id spread, too; a bundle sends each distinct key once, whatever
its number of occurrences, so that a key held by a third of all rows costs one entry a bundle. Keys of one bundle that
go to the same group travel as one packed row.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run of anything but ASCII blanks (Java, DuckDB and Python read this pattern alike).
WORD = r"[^\x20\x09-\x0D]+"
U64 = np.uint64


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below the checkpoint folder that driver and executors share (a default is set in local mode only)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file:///tmp/checkpoints/ringledger"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """`df` written as parquet into shared storage and read back: cuts lineage and outlives lost executors."""
    path = shared_dir(df.sparkSession)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes what `stored` wrote for `df`, once nothing reads it any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a column over all rows."""
    return int(docs.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def parts(total_bytes: int, each_mb: float, least: int = 1) -> int:
    """How many bundles of about `each_mb` hold `total_bytes`: grows in proportion to the input."""
    return max(least, math.ceil(total_bytes / (each_mb * 1e6)))


def bundle_of(columns: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*columns, F.lit("bundle")), F.lit(n)).cast("int")


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (the finaliser of the splitmix64 generator)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def raw_strings(array: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column as one array, and the n + 1 offsets into it; nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks() if array.num_chunks != 1 else array.chunk(0)
        if isinstance(array, pa.ChunkedArray):  # no chunk at all
            array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], array.type)
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if array.null_count:
        array = array.cast(pa.large_binary() if wide else pa.binary()).fill_null(b"")
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, at - at[0]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, which bounds what a worker holds beside a batch."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def split_blobs(values: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    """`values` cut at the given n + 1 places, each piece as bytes."""
    data, width = values.tobytes(), values.dtype.itemsize
    return [data[a * width : b * width] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, and the length of the array at the end."""
    n = len(sorted_values)
    if not n:
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [n]))

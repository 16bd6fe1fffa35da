"""Arrow batches of bounded size, and workers that give memory back."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of a record batch, in the JVM and again in Python; a row that is longer is a batch of its own.
BYTES = 4 << 20
_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def _returned(f: Callable) -> Callable:
    """`f`, after which the worker, which Spark keeps for later tasks, returns what it freed to the system."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
        if trim:
            trim(0)

    return run


def map_in_arrow(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """`df.mapInArrow(f, schema)` with batches of at most about BYTES bytes, however long the rows are.

    The session's own setting is lowered to that if it is higher."""
    spark = df.sparkSession
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_SETTING)) > BYTES:
        spark.conf.set(_SETTING, str(BYTES))
    return df.mapInArrow(_returned(f), schema)

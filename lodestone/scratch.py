"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing Parquet under `spark.checkpoint.dir`, so that the loss of an executor
costs at most one stage. Where that names no folder, one is made, but only for a local master: on a
cluster a folder of one machine would split a table over nodes.
"""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; on a local master without it, a folder made once per application."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    return _OWN[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path; nothing is there yet."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def scratch_root(spark: SparkSession) -> str:
    """The application's own folder in the shared one."""
    return f"{shared_dir(spark)}/lodestone/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read back, with sizes Spark knows."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def free(*tables: DataFrame) -> None:
    """Delete tables of `materialize` that nothing reads any more, neither a result nor a plan made of them."""
    for df in tables:
        release(df.sparkSession, _PATHS.pop(df))


def purge(spark: SparkSession) -> None:
    """Delete all scratch tables of this application, once no result reads them any more."""
    release(spark, scratch_root(spark))


def release(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through the file system that holds it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

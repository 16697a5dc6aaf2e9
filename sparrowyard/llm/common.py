"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of characters other than ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from ``spark.checkpoint.dir``.

    Where none is set, a local master gets a temporary folder; on a cluster its machines would not share one, so that raises.
    """
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        where = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(where)
    return where


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """The path as a URI, on the file system that Spark would take for it."""
    if "://" in path or path.startswith("file:"):
        return path
    store = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    return f"{store.rstrip('/') if not store.startswith('file:') else 'file://'}{path}"


def integer_id(df: DataFrame, id: str) -> None:
    """Raise TypeError unless the id column holds integers."""
    kind = df.select(id).schema[0].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"ids must be integers, {id} is {kind.simpleString()}")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it back.

    The table outlives lost executors, and later passes do not repeat what led to it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Remove a written table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def n_words_of(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")

"""Sessions, and shipping this package to the Python workers of a cluster."""

from __future__ import annotations

import functools
import os
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "sparrowyard", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` uses ``__`` for dots."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from ``spark.checkpoint.dir``.

    Where none is set, a local master gets a temporary one; machines of a cluster would not share it, so there it raises.
    """
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        where = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(where)
    return where.rstrip("/")


#: A task of a shuffle is meant to take so many of an input's rows, and so many bytes at most of what small partitions are merged to.
TASK_ROWS, TASK_BYTES = 100_000, 8 << 20
#: Bytes of rows that a byte of Parquet with packed integer keys may hold.
PACKED = 10.0


def _bytes(setting: str) -> int:
    """A size such as 64MB, 8m or 1048576b."""
    number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)i?b?", setting.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def spread(df: DataFrame) -> DataFrame:
    """The input, with the session's shuffles in as many partitions as its rows need, so that a task's memory does not grow with them.

    Settings only go up (partitions) or down (bytes): adaptive execution merges what small inputs leave empty, up to ``TASK_BYTES``,
    as a few packed megabytes of keys are millions of rows of a hash table. For the same reason a file counts as ``PACKED``
    times its size where Spark decides what to broadcast, which passes through the driver.
    """
    conf, merged = df.sparkSession.conf, "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    wanted = -(-df.count() // TASK_ROWS)  # Parquet answers from the footers
    if wanted > int(conf.get("spark.sql.shuffle.partitions")):
        conf.set("spark.sql.shuffle.partitions", wanted)
    if _bytes(conf.get(merged)) > TASK_BYTES:
        conf.set(merged, TASK_BYTES)
    if float(conf.get("spark.sql.sources.fileCompressionFactor")) < PACKED:
        conf.set("spark.sql.sources.fileCompressionFactor", str(PACKED))
    return df


_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, once an application."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    _sent.add(sc.applicationId)
    here = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="spark-"), "sparrowyard")
    sc.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(here), os.path.basename(here)))


def shipped(query):
    """The query, with the package sent first."""

    @functools.wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run

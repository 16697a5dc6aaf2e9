"""Event-time jobs: the same functions serve a stream and its batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparrowyard.streaming.keyed_table import KeyedTable


def with_event_time(df: DataFrame, col: str, delay: str) -> DataFrame:
    """Rows with an event time; on a stream, with a watermark."""
    df = df.withColumn(col, F.col(col).cast("timestamp")).where(F.col(col).isNotNull())
    return df.withWatermark(col, delay) if df.isStreaming else df


def counts(df: DataFrame, ts: str, keys: list[str], size: str, slide: str | None = None) -> DataFrame:
    """Counts per tumbling or sliding window and keys."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = df.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def averages(df: DataFrame, ts: str, key: str, value: str, size: str, dim: DataFrame | None = None) -> DataFrame:
    """Mean and count per window and key, with a static dimension's columns joined on."""
    out = df.groupBy(F.window(ts, size).alias("w"), key).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    out = out.select(F.col("w.start").alias("start"), key, "mean", "n")
    return out.join(dim, key, "left") if dim is not None else out


def start_parquet(df: DataFrame, name: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append everything that is available, restartable from its checkpoint."""
    return df.writeStream.queryName(name).format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_latest(path: str, keys: list[str], order: str, **layout):
    """For foreachBatch: the newest row per key in a ``KeyedTable``; a batch that comes twice changes nothing.

    ``layout`` may set the table's ``buckets`` and ``fan``. ``snapshot`` reads the table.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        KeyedTable(batch.sparkSession, path, keys, order, **layout).upsert(batch, batch_id)

    return write


def snapshot(spark, path: str, before: int | None = None) -> DataFrame | None:
    """The table's rows (as of the batches below ``before``); none if nothing was written."""
    return KeyedTable(spark, path).read(before)

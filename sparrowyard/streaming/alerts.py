"""Alerts on streams: bursts from keyed state, cycles from a table of recent transfers, one alert per id."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from sparrowyard.operators import alerts
from sparrowyard.streaming import windows

HIT = StructType([StructField("pattern", StringType()), StructField("accounts", StringType()), *[StructField(n, LongType()) for n in ("ms", "amount_cents", "n", "tx_id")], StructField("ts", TimestampType())])
RECENT = StructType([StructField(n, LongType()) for n in ("ms", "amount", "small")])
RAISED = StructType([StructField("velocity", LongType()), StructField("structuring", LongType()), StructField("timer", LongType())])


class Bursts(StatefulProcessor):
    """Velocity and structuring of an origin: its transactions of the longest span, and the minute each rule last fired in.

    A rule yields its first hit of each minute. A timer at the end of the span clears an origin that has gone quiet.
    """

    def __init__(self, velocity: tuple, structuring: tuple) -> None:
        self.velocity, self.structuring = velocity, structuring

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", RECENT)
        self.raised = handle.getValueState("raised", RAISED)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (fast, span), (many, long, below) = self.velocity, self.structuring
        old = [tuple(x) for x in self.recent.get()] if self.recent.exists() else []
        last = list(self.raised.get()) if self.raised.exists() else [-1, -1, -1]
        fresh = sorted(
            (ms, tx, amount, int(kind == "TRANSFER" and amount < below))
            for f in rows for ms, tx, amount, kind in zip(f["ms"].tolist(), f["tx_id"].tolist(), f["amount_cents"].tolist(), f["type"].tolist(), strict=True)
        )
        all_ = sorted([*old, *[(ms, amount, small) for ms, _, amount, small in fresh]])
        # running counts and sums of all and of small ones; a span is a difference of two
        low = {"VELOCITY": 0, "STRUCTURING": 0}
        high, sums, before = 0, [(0, 0, 0, 0)], [x[0] for x in all_]
        for _, amount, small in all_:
            n, total, m, part = sums[-1]
            sums.append((n + 1, total + amount, m + small, part + small * amount))
        out = []
        for ms, tx, _, small in fresh:
            while high < len(before) and before[high] <= ms:
                high += 1
            for i, (pattern, width, least) in enumerate((("VELOCITY", span, fast), ("STRUCTURING", long, many))):
                while before[low[pattern]] < ms - width:
                    low[pattern] += 1
                if i and not small:
                    continue
                n, total = (sums[high][2 * i + j] - sums[low[pattern]][2 * i + j] for j in (0, 1))
                if n >= least and last[i] != ms // alerts.MINUTE:
                    last[i] = ms // alerts.MINUTE
                    out.append((pattern, str(key[0]), ms, total, n, tx, pd.Timestamp(ms, unit="ms")))
        newest = before[-1]
        self.recent.put([x for x in all_ if x[0] >= newest - max(span, long)])
        if last[2] >= 0:
            self.handle.deleteTimer(last[2])
        last[2] = newest + max(span, long)
        self.handle.registerTimer(last[2])
        self.raised.update(tuple(last))
        if out:
            yield pd.DataFrame(out, columns=HIT.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.recent.clear()
        self.raised.clear()
        return iter(())

    def close(self) -> None:
        pass


def burst_stream(tx: DataFrame, velocity: tuple = (15, 60_000), structuring: tuple = (8, 3_600_000, 1_000_000), delay: str = "2 minutes") -> DataFrame:
    """Velocity and structuring alerts of a stream of transactions, each id once; a transaction that comes again counts once.

    Equal to ``alerts.alerts`` of these rules where batches come in order of time; disorder within a batch does
    no harm. ``delay`` (a minute at least) is how late a repeat may come. Transactions of a null origin are left out.
    """
    rows = tx.where("orig is not null").select("tx_id", "orig", "ms", "amount_cents", "type", F.timestamp_millis("ms").alias("ts"))
    timed = windows.with_event_time(rows, "ts", delay).dropDuplicatesWithinWatermark(["tx_id"])
    found = timed.groupBy("orig").transformWithStateInPandas(Bursts(velocity, structuring), HIT, outputMode="Append", timeMode="EventTime", eventTimeColumnName="ts")
    return alerts.identified(found).dropDuplicatesWithinWatermark(["alert_id"]).select(*alerts.ALERT)


class EdgeTable:
    """Recent transfers by time bucket, a folder per micro-batch, below which a bucket is one folder.

    A batch that comes again replaces its own folder and sees the same older ones. Folders whose buckets have
    all left the window are removed before a batch is read, by the times of the batches before it.
    """

    def __init__(self, spark: SparkSession, path: str, span: int, keep: int) -> None:
        self.spark, self.path, self.span, self.keep = spark, path, span, keep
        self.at = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.at(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, path: str, prefix: str) -> list[int]:
        if not self.fs.exists(self.at(path)):
            return []
        return sorted(int(n[len(prefix) :]) for n in (s.getPath().getName() for s in self.fs.listStatus(self.at(path))) if n.startswith(prefix))

    def buckets(self, before: int) -> dict[int, list[int]]:
        """Complete batches below a number, with their buckets."""
        found = [b for b in self._names(self.path, "batch=") if b < before and self.fs.exists(self.at(f"{self.path}/batch={b}/_SUCCESS"))]
        return {b: self._names(f"{self.path}/batch={b}", "bucket=") for b in found}

    def prune(self, before: int) -> None:
        held = self.buckets(before)
        newest = max((x for bs in held.values() for x in bs), default=0)
        for b, bs in held.items():
            if max(bs, default=newest) < newest - self.keep:
                self.fs.delete(self.at(f"{self.path}/batch={b}"), True)

    def put(self, edges: DataFrame, batch: int) -> DataFrame:
        bucket = F.floor(F.col("ms") / self.span)
        edges.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/batch={batch}")
        return self.spark.read.schema(edges.schema.add("bucket", "long")).parquet(f"{self.path}/batch={batch}")

    def near(self, new: DataFrame, before: int) -> DataFrame:
        """Edges of older batches in the buckets of ``new`` and those next to them."""
        mine = [r[0] for r in new.select("bucket").distinct().collect()]  # a row per time bucket of one batch
        wanted = {b + d for b in mine for d in (-1, 0, 1)}
        paths = [f"{self.path}/batch={b}/bucket={k}" for b, ks in self.buckets(before).items() for k in ks if k in wanted]
        if not paths:
            return new.limit(0).drop("bucket")
        return self.spark.read.schema(new.drop("bucket").schema).parquet(*paths)


def cycle_sink(spark: SparkSession, edges: str, out: str, span: int = 600_000, min_total: int = 100_000_000, keep: int = 2):
    """For foreachBatch: hits of cycles in which a transfer of the batch takes part, below ``out`` by batch.

    A cycle is found in the batch that brings its last transfer, so each comes once, whatever the batches; a
    cycle whose transfers come out of order is found as long as they are no more than ``keep`` buckets of one span late.
    Of the older transfers, only those that leave a new one's target or enter a new one's origin are read into
    the join, so the work follows the batch and its neighbourhood, not the window.
    """
    table = EdgeTable(spark, edges, span, keep)
    columns = ["tx_id", "orig", "dest", "ms", "amount_cents"]

    def write(batch: DataFrame, batch_id: int) -> None:
        table.prune(batch_id)
        new = table.put(batch.select(*columns).where("orig <> dest"), batch_id)
        old = table.near(new, batch_id)
        after = old.join(new.select(F.col("dest").alias("orig")).distinct(), "orig", "left_semi").select(*columns)
        before = old.join(new.select(F.col("orig").alias("dest")).distinct(), "dest", "left_semi").select(*columns)
        both = after.unionByName(before).dropDuplicates(["tx_id"]).join(new.select("tx_id"), "tx_id", "left_anti").select(*columns).unionByName(new.select(*columns))
        found = alerts.cycle_hits(both, span, min_total)
        fresh = found.withColumn("tx_id", F.explode("tx_ids")).join(new.select("tx_id"), "tx_id", "left_semi").drop("tx_id").dropDuplicates(["tx_ids"])
        fresh.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return write


def start_cycles(transfers: DataFrame, edges: str, out: str, checkpoint: str, **rules) -> StreamingQuery:
    """Cycles of a stream of transfers, restartable from its checkpoint; ``cycle_alerts`` reads them. Rules as for ``cycle_sink``."""
    put = cycle_sink(transfers.sparkSession, edges, out, **rules)
    return transfers.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cycle_alerts(spark: SparkSession, out: str) -> DataFrame:
    """The alerts, one per id, of all batches of cycle hits."""
    return alerts.first_of_minute(spark.read.option("basePath", out).parquet(out).drop("batch"))

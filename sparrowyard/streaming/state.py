"""Keyed state on streams: the ordered ledger and trailing-window alerts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sparrowyard.streaming import windows

OUTCOME = StructType([StructField(n, t) for n, t in (("tx_id", LongType()), ("ms", LongType()), ("account", LongType()), ("delta_cents", LongType()), ("kind", StringType()), ("status", StringType()), ("balance_cents", LongType()), ("apply_seq", LongType()))])
BUFFERED = StructType([StructField(n, t) for n, t in (("ms", LongType()), ("tx_id", LongType()), ("kind", StringType()), ("delta", LongType()))])
HELD = StructType([StructField("balance", LongType()), StructField("seq", LongType())])
ALERT = StructType([StructField(n, LongType()) for n in ("tx_id", "orig", "ms", "n", "total")])
SPAN = StructType([StructField("ms", LongType()), StructField("amount", LongType())])


class Settlement(StatefulProcessor):
    """Holds an account's operations until the watermark has passed them, then applies them by (time, transaction, kind).

    Operations are buffered as state and released by one timer per distinct time, so the state is bounded by
    the watermark's delay, not by the account's history.
    """

    def __init__(self, opening: int) -> None:
        self.opening = opening

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", HELD)
        self.waiting = handle.getMapState("waiting", StructType([BUFFERED.fields[0]]), StructType([StructField("ops", StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: dict[int, list[str]] = {}
        if key[0] is None or key[0] != key[0]:  # beats, and operations of no account
            return iter(())
        for f in rows:
            for ms, tx, kind, delta in zip(f["ms"].tolist(), f["tx_id"].tolist(), f["kind"].tolist(), f["delta_cents"].tolist(), strict=True):
                new.setdefault(ms, []).append(f"{tx}\t{kind}\t{delta}")
        for ms, ops in new.items():
            old = [self.waiting.getValue((ms,))[0]] if self.waiting.containsKey((ms,)) else []
            self.waiting.updateValue((ms,), ("\n".join(old + ops),))
            self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ms = expiredTimerInfo.getExpiryTimeInMs()
        if not self.waiting.containsKey((ms,)):
            return
        balance, seq = self.held.get() if self.held.exists() else (self.opening, 0)
        out = []
        for tx, kind, delta in sorted((int(t), k, int(d)) for t, k, d in (line.split("\t") for line in self.waiting.getValue((ms,))[0].split("\n"))):
            ok = delta >= 0 or -delta <= balance
            balance, seq = balance + (delta if ok else 0), seq + 1
            out.append((tx, ms, key[0], delta, kind, "SETTLED" if ok else "REJECTED", balance, seq))
        self.held.update((balance, seq))
        self.waiting.removeKey((ms,))
        yield pd.DataFrame(out, columns=OUTCOME.names)

    def close(self) -> None:
        pass


class IdleSettlement(Settlement):
    """As ``Settlement``, but on the clock: operations wait until the account's newest one is ``delay_ms`` ahead of them,
    and all that still wait are applied once the account has had no input for ``idle_ms``."""

    def __init__(self, opening: int, delay_ms: int, idle_ms: int) -> None:
        super().__init__(opening)
        self.delay_ms, self.idle_ms = delay_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.clock = handle.getValueState("clock", StructType([StructField("newest", LongType()), StructField("timer", LongType())]))

    def _apply(self, key, upto: int | None) -> Iterator[pd.DataFrame]:
        due = sorted(ms for (ms,), _ in self.waiting.iterator() if upto is None or ms <= upto)
        balance, seq = self.held.get() if self.held.exists() else (self.opening, 0)
        out = []
        for ms in due:
            for tx, kind, delta in sorted((int(t), k, int(d)) for t, k, d in (line.split("\t") for line in self.waiting.getValue((ms,))[0].split("\n"))):
                ok = delta >= 0 or -delta <= balance
                balance, seq = balance + (delta if ok else 0), seq + 1
                out.append((tx, ms, key[0], delta, kind, "SETTLED" if ok else "REJECTED", balance, seq))
            self.waiting.removeKey((ms,))
        if out:
            self.held.update((balance, seq))
            yield pd.DataFrame(out, columns=OUTCOME.names)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0] is None or key[0] != key[0]:
            return
        newest, timer = self.clock.get() if self.clock.exists() else (None, None)
        for f in rows:
            for ms, tx, kind, delta in zip(f["ms"].tolist(), f["tx_id"].tolist(), f["kind"].tolist(), f["delta_cents"].tolist(), strict=True):
                old = [self.waiting.getValue((ms,))[0]] if self.waiting.containsKey((ms,)) else []
                self.waiting.updateValue((ms,), ("\n".join([*old, f"{tx}\t{kind}\t{delta}"]),))
                newest = ms if newest is None else max(newest, ms)
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
        self.handle.registerTimer(timer)
        self.clock.update((newest, timer))
        yield from self._apply(key, newest - self.delay_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.clock.update((self.clock.get()[0], None))
        yield from self._apply(key, None)


def settle_when_idle(ops: DataFrame, delay_ms: int = 5000, idle_ms: int = 30_000, opening: int = 500_000_000) -> DataFrame:
    """Outcomes of a stream of operations without a watermark: the rest is applied after an account's idle time.

    Equal to ``ledger.settle`` where an account's operations are out of order by less than ``delay_ms`` and no
    older one comes after an idle drain; such a late operation is applied when it comes. The clock's timers need a
    query that keeps running (any trigger but availableNow).
    """
    rows = ops.select("tx_id", "ms", "account", "delta_cents", "kind")
    return rows.groupBy("account").transformWithStateInPandas(IdleSettlement(opening, delay_ms, idle_ms), OUTCOME, outputMode="Append", timeMode="ProcessingTime")


def settle_stream(ops: DataFrame, delay: str = "5 seconds", opening: int = 500_000_000, beats: DataFrame | None = None) -> DataFrame:
    """Outcomes of a stream of operations, equal to ``ledger.settle`` on all that came before the watermark.

    The delay must exceed the input's disorder: rows below the watermark are dropped by Spark. Operations at or
    above the last watermark wait; a later row of any account moves it and so drains them. ``beats``, a stream
    with ``ms`` (the clock less the idle time, say, see ``clock``), moves it too when no operations come in.
    Operations of a null account are left out.
    """
    ops = ops.select("tx_id", "ms", "account", "delta_cents", "kind")
    if beats is not None:
        ops = ops.unionByName(beats.select(F.col("ms").cast("long").alias("ms")), allowMissingColumns=True)
    timed = windows.with_event_time(ops.withColumn("ts", F.timestamp_millis("ms")), "ts", delay)
    return timed.groupBy("account").transformWithStateInPandas(Settlement(opening), OUTCOME, outputMode="Append", timeMode="EventTime")


def clock(spark: SparkSession, idle: int = 30) -> DataFrame:
    """Beats for ``settle_stream``: one row a second, the wall clock less so many idle seconds, for times that follow it."""
    beats = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return beats.select((F.unix_millis("timestamp") - idle * 1000).alias("ms"))


class Trailing(StatefulProcessor):
    """Counts and sums an origin's transactions of the trailing span; older ones leave the state."""

    def __init__(self, n: int, span: int) -> None:
        self.n, self.span = n, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", SPAN)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = [(ms, a) for ms, a in self.recent.get()] if self.recent.exists() else []
        fresh = sorted((ms, tx, a) for f in rows for ms, tx, a in zip(f["ms"].tolist(), f["tx_id"].tolist(), f["amount_cents"].tolist(), strict=True))
        out = []
        span = kept + [(ms, a) for ms, _, a in fresh]
        span.sort(key=lambda x: x[0])
        low, high, total = 0, 0, 0
        for ms, tx, _ in fresh:
            while high < len(span) and span[high][0] <= ms:
                total, high = total + span[high][1], high + 1
            while span[low][0] < ms - self.span:
                total, low = total - span[low][1], low + 1
            if high - low >= self.n:
                out.append((tx, key[0], ms, high - low, total))
        newest = span[-1][0] if span else 0
        left = [x for x in span if x[0] >= newest - self.span]
        if left:
            self.recent.put(left)
        if out:
            yield pd.DataFrame(out, columns=ALERT.names)

    def close(self) -> None:
        pass


def aml_stream(tx: DataFrame, n: int = 15, span: int = 60_000) -> DataFrame:
    """Transactions whose origin has n or more in the trailing span; equal to ``ledger.velocity`` on input in order.

    A batch's rows of an origin are put in order first, so disorder within a batch does no harm.
    """
    return tx.groupBy("orig").transformWithStateInPandas(Trailing(n, span), ALERT, outputMode="Append", timeMode="None")

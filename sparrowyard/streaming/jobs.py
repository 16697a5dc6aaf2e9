"""Streams of lines and messages, their sinks, their progress and how long they run."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from sparrowyard.operators import reports
from sparrowyard.operators import relational as R
from sparrowyard.streaming import windows


# transformations, alike on a stream and its batch twin
def words_of(lines: DataFrame, user: str = "user_id", text: str = "value") -> DataFrame:
    """Each word of a line with its user and position."""
    rows = lines.where(F.col(text).isNotNull()).select(user, F.posexplode(F.split(F.trim(text), r"\s+")).alias("pos", "word"))
    return rows.where("word <> ''")


def attach_meaning(words: DataFrame, meanings: DataFrame) -> DataFrame:
    """Words that the static table ``meanings(word, meaning)`` knows."""
    return words.join(meanings, "word")


def enrich_stream(stream: DataFrame, dim: DataFrame, on) -> DataFrame:
    """Every row of the stream, with a static dimension's columns where it has them."""
    return stream.join(dim, on, "left")


def users_of_words(words: DataFrame, user: str = "user_id") -> DataFrame:
    return words.groupBy("word").agg(F.sort_array(F.collect_set(user)).alias("users"))


def meanings_per_request(words: DataFrame, meanings: DataFrame, keys: list[str]) -> DataFrame:
    """Per request: the meanings of its words in order; unknown words are left out. On a stream, for foreachBatch.

    The list is as long as the request's own text.
    """
    rows = attach_meaning(words, meanings).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "meaning"))).alias("m"))
    return rows.select(*keys, F.transform("m", lambda x: x["meaning"]).alias("meanings"))


def flatten_orders(messages: DataFrame, schema: str, items: str, value: str = "value") -> DataFrame:
    """One row per item of each JSON order; an order without items has one row of nulls, a broken one none."""
    orders = messages.select(F.from_json(F.col(value).cast("string"), schema).alias("o")).where("o is not null").select("o.*").dropna(how="all")
    flat = orders.withColumn("_item", F.explode_outer(items)).drop(items)
    return flat.select(*[c for c in flat.columns if c != "_item"], "_item.*")


def latency(df: DataFrame, began: str, ended: str, keys: list[str]) -> DataFrame:
    """Milliseconds between two times: count, mean and interpolated percentiles per key."""
    ms = (F.unix_micros(F.col(ended).cast("timestamp")) - F.unix_micros(F.col(began).cast("timestamp"))) / 1000
    rows = df.select(*keys, ms.alias("ms"))
    return rows.groupBy(*keys).agg(F.count("ms").alias("n"), F.avg("ms").alias("mean_ms"), *[F.percentile("ms", F.lit(p / 100)).alias(f"p{p}") for p in (50, 95, 99)])


def daily_peaks(trips: DataFrame, ts: str) -> DataFrame:
    """Trips per day."""
    return windows.counts(trips, ts, [], "1 day")


def avg_by_zone(trips: DataFrame, ts: str, zone: str, seconds: str, zones: DataFrame, size: str = "1 day") -> DataFrame:
    """Mean minutes (two places, halves up) and trips per window and zone, with the zone's columns where it is known."""
    out = windows.averages(trips, ts, zone, seconds, size, zones)
    return out.withColumn("mean", F.round((F.col("mean") / 60).cast("decimal(38,10)"), 2).cast("double"))


def candles(trades: DataFrame, ts: str, key: str, size: str, delay: str, traced: bool = False) -> DataFrame:
    """Candles per window and key; appended once the watermark passes a window on a stream.

    ``traced`` adds what latency and gaps are told from: the trades' mean time in ms, their first and last id.
    """
    rows = windows.with_event_time(trades, ts, delay).withColumnRenamed(key, "_key").withColumn("_w", F.window(ts, size))
    more = [F.avg(F.unix_millis(F.col(ts).cast("timestamp"))).alias("mean_ms"), F.min("trade_id").alias("first_id"), F.max("trade_id").alias("last_id")] if traced else []
    out = R.ohlcv(rows, ["_w", "_key"], more)
    return out.select(F.col("_w.start").alias("start"), F.col("_key").alias(key), *[c for c in out.columns if c not in ("_w", "_key")])


def candle_sink(out: str, metrics: str, key: str, clock: Callable[[], float] = time.time) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: traced candles to ``out``, and one row about the batch to ``metrics``; a batch that comes again replaces its own.

    ``latency_ms`` runs from a candle's mean trade time to the moment of writing: mean and interpolated percentiles over candles.
    ``gaps`` counts trade ids that are missing between a key's first and last ones of the batch; ``trades_per_s`` are those of the time the
    write took.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, began = batch.sparkSession, time.time()
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        saved, now, took = spark.read.schema(batch.schema).parquet(f"{out}/batch={batch_id}"), clock() * 1000, time.time() - began
        ms = F.lit(now) - F.col("mean_ms")
        figures = saved.agg(F.count("*").alias("candles"), F.coalesce(F.sum("trades"), F.lit(0)).alias("trades"), F.avg(ms).alias("latency_ms"), *[F.percentile(ms, F.lit(p / 100)).alias(f"p{p}_ms") for p in (50, 95, 99)])
        missing = saved.groupBy(key).agg((F.max("last_id") - F.min("first_id") + 1 - F.sum("trades")).alias("m")).agg(F.coalesce(F.sum("m"), F.lit(0)).cast("long").alias("gaps"))
        row = figures.crossJoin(missing).withColumn("trades_per_s", F.col("trades") / F.lit(max(took, 1e-3)))  # two rows of one each
        row.coalesce(1).write.mode("overwrite").parquet(f"{metrics}/batch={batch_id}")

    return write


# sources' rates and sinks
def rate_limit(n: int, source: str = "kafka") -> dict[str, str]:
    """Reader options that hold a micro-batch to n offsets (Kafka) or files."""
    return {"maxOffsetsPerTrigger" if source == "kafka" else "maxFilesPerTrigger": str(n)}


def start_console(df: DataFrame, mode: str = "append", truncate: bool = False, seconds: float | None = None) -> StreamingQuery:
    q = df.writeStream.format("console").outputMode(mode).option("truncate", truncate).start()
    if seconds is not None:
        q.awaitTermination(seconds)
    return q


def start_kafka(df: DataFrame, servers: str, topic: str, checkpoint: str) -> StreamingQuery:
    """Rows as JSON to a topic, at least once: readers settle repeats by key and sequence (see ``upsert_if_newer``)."""
    rows = df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    return rows.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()


def jdbc_sink(url: str, table: str, props: dict[str, str] | None = None, batch_size: int = 1000) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: append to a table."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("append").option("batchsize", batch_size).jdbc(url, table, properties=props or {})

    return write


def upsert_if_newer(path: str, keys: list[str], seq: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a row replaces its key's row only with a greater sequence number."""
    return windows.upsert_latest(path, keys, seq)


def latest_window_sink(path: str, keys: list[str], window: str, count: str, order: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: all windows of the batch are upserted; ``latest_scores`` reads the newest one."""
    return windows.upsert_latest(path, [window, *keys], order)


def latest_scores(spark, path: str, window: str, count: str) -> DataFrame | None:
    """The newest window's rows with their trend score, from the upserted table."""
    rows = windows.snapshot(spark, path)
    return None if rows is None else R.trend_score(reports.latest_window(rows, window), window, count)


def with_metrics(name: str, write: Callable[[DataFrame, int], None], report: Callable[[dict], None] = print) -> Callable[[DataFrame, int], None]:
    """``write`` that also reports rows, milliseconds and rows a second; rows are counted while they are written."""

    def run(batch: DataFrame, batch_id: int) -> None:
        from pyspark.sql import Observation

        seen, began = Observation(), time.time()
        write(batch.observe(seen, F.count(F.lit(1)).alias("rows")), batch_id)
        ms = (time.time() - began) * 1000
        rows = seen.get["rows"]
        report({"name": name, "batch": batch_id, "rows": rows, "ms": round(ms, 1), "rows_per_s": round(rows * 1000 / ms, 1) if ms else 0.0})

    return run


def sorted_complete(counts: DataFrame, *order) -> DataFrame:
    """An aggregate in order: on a stream it needs the complete output mode, whose whole result is written each time."""
    return counts.orderBy(*order)


# running
class ProgressListener(StreamingQueryListener):
    """Appends one JSON line a micro-batch to a file of the driver."""

    def __init__(self, path: str) -> None:
        self.path = path

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        line = {"run": p.name, "batchId": p.batchId, "timestamp": p.timestamp, "numInputRows": p.numInputRows, "inputRowsPerSecond": p.inputRowsPerSecond, "processedRowsPerSecond": p.processedRowsPerSecond, "triggerExecutionMs": p.durationMs.get("triggerExecution"), "addBatchMs": p.durationMs.get("addBatch")}
        with open(self.path, "a") as f:
            f.write(json.dumps(line) + "\n")


def start_all(jobs: dict[str, DataFrame], out: str, checkpoint: str) -> list[StreamingQuery]:
    """One query for each result of a source, each with its own checkpoint and folder."""
    return [windows.start_parquet(df, name, f"{out}/{name}", f"{checkpoint}/{name}") for name, df in jobs.items()]


def restartable(start: Callable[[str], StreamingQuery], checkpoint: str, attempts: int = 3) -> StreamingQuery:
    """Runs ``start(checkpoint)`` to its end; a query that fails is started again from its checkpoint.

    The checkpoint repeats the batch that failed with the same rows, so a sink that is idempotent by batch
    (files, ``upsert_latest``) neither loses nor doubles any. The last failure is raised.
    """
    for left in reversed(range(attempts)):
        query = start(checkpoint)
        try:
            query.awaitTermination()
            return query
        except StreamingQueryException:
            if not left:
                raise
    raise ValueError("attempts must be 1 or more")


def run_until_idle(queries: list[StreamingQuery], polls: int = 3, every: float = 1.0, timeout: float = 600.0) -> bool:
    """Waits until all queries have ended or had no new rows for ``polls`` polls, then stops them; false on timeout."""
    until, quiet, batches = time.time() + timeout, 0, None
    done = False
    while not done and time.time() < until:
        time.sleep(every)
        state = [(q.id, q.lastProgress.batchId if q.lastProgress else -1) for q in queries]
        busy = any(q.isActive and (q.status["isTriggerActive"] or q.lastProgress is None or q.lastProgress.numInputRows > 0 and state != batches) for q in queries)
        quiet, batches = (0 if busy or state != batches else quiet + 1), state
        done = quiet >= polls or not any(q.isActive for q in queries)
    for q in queries:
        if q.isActive:
            q.stop()
    return done

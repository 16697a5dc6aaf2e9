"""Whole jobs put together from the operators: each takes DataFrames or paths and returns DataFrames or running queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparrowyard.functions import columns as C
from sparrowyard.functions import udfs
from sparrowyard.operators import alerts, graph, indicators, ledger, logs, reports
from sparrowyard.operators import relational as R
from sparrowyard.sources import files, sinks
from sparrowyard.streaming import jobs, windows

NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


# batch
def log_metrics(spark: SparkSession, src: str, out: str) -> None:
    """Run logs to one CSV row a run, with the repetition number from the file's name."""
    lines = files.read_logs(spark, src)
    names = lines.select("file", F.col("rep").alias("repetition")).distinct()
    sinks.write_csv(logs.log_etl(lines).join(names, "file"), out)


def profile(df: DataFrame, max_ndv: int = 50) -> DataFrame:
    """``column, metric, value`` (text): rows, nulls, figures and distinct counts of numbers, ends of dates, counts or samples of texts."""
    kinds = dict(df.dtypes)
    numeric = [c for c in df.columns if kinds[c].split("(")[0] in NUMBERS]
    dated = [c for c in df.columns if kinds[c].startswith(("date", "timestamp"))]
    texts = [c for c in df.columns if kinds[c] in ("string", "boolean")]

    def long(wide: DataFrame) -> DataFrame:
        cells = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in wide.columns if c != "column"]
        return wide.select("column", F.inline(F.array(*cells)))

    parts = [long(R.null_profile(df))] if df.columns else []
    if numeric:
        parts.append(long(R.numeric_profile(df, numeric)))
    if dated:
        one = df.agg(*[f(c).alias(f"{n}_{i}") for i, c in enumerate(dated) for n, f in (("min", F.min), ("max", F.max))])
        cells = [F.struct(F.lit(c).alias("column"), F.lit(n).alias("metric"), F.col(f"{n}_{i}").cast("string").alias("value")) for i, c in enumerate(dated) for n in ("min", "max")]
        parts.append(one.select(F.inline(F.array(*cells))))
    if texts:
        counts = R.value_counts(df, texts, max_ndv)
        parts.append(counts.select("column", F.concat(F.lit("count of "), F.coalesce("value", F.lit("null"))).alias("metric"), F.col("n").cast("string").alias("value")))
        some = R.unique_values(df, texts, max_ndv)
        parts.append(some.select("column", F.lit("ndv").alias("metric"), F.col("ndv").cast("string").alias("value")))
        parts.append(some.select("column", F.posexplode("values").alias("i", "value")).select("column", F.concat(F.lit("sample "), F.col("i") + 1).alias("metric"), "value"))
    if not parts:
        raise ValueError("a table without columns has no profile")
    return R.union_all(*parts)


def payments(tx: DataFrame, opening: int = ledger.OPENING, velocity: tuple = (15, 60_000), structuring: tuple = (8, 3_600_000, 1_000_000), cycle: tuple = (600_000, 100_000_000), fraud: Column | None = None, streamed: DataFrame | None = None) -> dict[str, DataFrame]:
    """Outcomes, balances and alerts; with a fraud condition the alerts' ``quality``; with a stream's balances, ``divergent`` accounts and the ``reconciled`` row.

    ``streamed`` has ``account, balance_cents``, such as the table that ``jobs.upsert_if_newer`` keeps of ``state.settle_stream``.
    """
    outcomes = graph.cut(ledger.settle(ledger.expand_ops(tx), opening))
    found = alerts.alerts(tx, velocity=velocity, structuring=structuring, cycle=cycle)
    out = {"outcomes": outcomes, "balances": ledger.balances(outcomes), "alerts": found}
    if fraud is not None:
        out["quality"] = reports.precision_recall(found, "accounts", tx.where(fraud).select(F.col("orig").cast("string").alias("account")))
    if streamed is not None:
        out["divergent"], out["reconciled"] = R.reconciled(streamed, out["balances"], "account", "balance_cents")
    return out


def blob_etl(spark: SparkSession, src: str, out: str, decode, prefixes: dict[str, str], fallback: bytes = b"", glob: str = "*", partitions: int | None = None) -> int:
    """Files to Parquet with a label from the name and decoded content; returns the checked row count."""
    blobs = files.read_blobs(spark, src, glob).select("path", files.label_from_name(F.col("path"), prefixes).alias("label"), "content")
    blobs = blobs.repartition(partitions, "path") if partitions else blobs.repartition("path")
    return sinks.write_parquet_checked(blobs.withColumn("content", udfs.make_decoder(decode, fallback)("content")), out)


def bike_trips(fields: DataFrame, started: int = 2, ended: int = 3, station: int = 4, rider: int = 12) -> dict[str, DataFrame]:
    """From rows of 13 text fields: trips with the flag of the top three stations, counters, minutes per rider, peak hour."""
    at = lambda i: F.try_to_timestamp(F.get("fields", F.lit(i)))
    text = lambda i: F.nullif(F.get("fields", F.lit(i)), F.lit(""))
    trips = fields.select("fields", at(started).alias("started"), at(ended).alias("ended"), text(station).alias("station"), text(rider).alias("rider"))
    flagged = R.flag_members(trips, "station", R.top_keys(trips.where("station is not null"), "station", 3).select("station"), "starting_station_top3")
    missing = F.exists("fields", lambda x: x == "")
    counters = trips.agg(F.count("*").alias("trips"), F.count_if(missing).alias("missing"), F.count_if(F.col("rider") == "casual").alias("casual"), F.count_if(F.col("rider") == "member").alias("member"))
    minutes = (F.unix_micros("ended") - F.unix_micros("started")) / 6e7
    return {
        "trips": flagged, "counters": counters, "minutes": trips.groupBy("rider").agg(F.avg(minutes).alias("minutes")),
        "peak_hour": R.top_keys(trips.where("started is not null").select(F.hour("started").alias("hour")), "hour", 1),
    }


def run_report(runs: DataFrame, config: str, workers: str, metric: str, base: int, work: Column | None = None) -> DataFrame:
    """Mean, deviation, 95 % confidence half-width, speedup, efficiency and (of ``work`` units a run) throughput per configuration and worker count."""
    return R.speedup(R.half_width(R.config_stats(runs, [config, workers], metric)), config, workers, base, work)


# streams
def taxi_stream(trips: DataFrame, zones: DataFrame, out: str, checkpoint: str, size: str = "5 minutes", delay: str = "10 minutes") -> list[StreamingQuery]:
    """Clean canonical trips; their counts and mean durations per window and zone, as two tables with own checkpoints."""
    clean = windows.with_event_time(trips, "pickup_datetime", delay).where("trip_duration_s > 0 and pu_location_id is not null")
    return jobs.start_all({
        "counts": windows.counts(clean, "pickup_datetime", ["pu_location_id"], size),
        "durations": windows.averages(clean, "pickup_datetime", "pu_location_id", "trip_duration_s", size, zones),
    }, out, checkpoint)


def edit_stream(events: DataFrame, classify, out: str, checkpoint: str, size: str = "10 minutes", delay: str = "1 hour") -> StreamingQuery:
    """Edits to readable texts, categories and window counts, upserted with metrics; ``jobs.latest_scores`` reads them.

    ``events`` has ``title, comment, parsedcomment, namespace, ts``; ``classify`` gives ``name|confidence`` of a text.
    """
    text = C.clean_text(F.col("title"), F.col("comment"), F.col("parsedcomment"), F.col("namespace"))
    labelled = windows.with_event_time(events, "ts", delay).withColumn("text", text).where(F.length("text") > 0)
    labelled = labelled.withColumn("category", C.split_label(classify(F.col("text")))["category"])
    table = windows.counts(labelled, "ts", ["category"], size)
    put = jobs.with_metrics("edits", jobs.latest_window_sink(out, ["category"], "start", "n", "n"))
    return table.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def trade_stream(trades: DataFrame, out: str, checkpoint: str, size: str = "1 minute", delay: str = "10 seconds", metrics: str | None = None) -> StreamingQuery:
    """Candles, appended as Parquet; ``candle_indicators`` reads the history back.

    With ``metrics``, each micro-batch's latency, throughput and gaps in trade ids are written there (see ``jobs.candle_sink``).
    """
    if metrics is None:
        return windows.start_parquet(jobs.candles(trades, "ts", "symbol", size, delay), "candles", out, checkpoint)
    put = jobs.candle_sink(out, metrics, "symbol")
    return jobs.candles(trades, "ts", "symbol", size, delay, traced=True).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def candle_indicators(spark: SparkSession, path: str) -> DataFrame:
    """EMA and RSI of the closing prices in a table of candles, per symbol."""
    candles = spark.read.parquet(path)
    return indicators.ema(candles, "symbol", "start", "close").join(indicators.rsi(candles, "symbol", "start", "close"), "symbol", "full_outer")


def sensor_stream(readings: DataFrame, sink, checkpoint: str, probable: float = 50, imminent: float = 80) -> StreamingQuery:
    """Readings (``temp, humidity, co2, alert``) with risk and class to a foreachBatch sink such as ``jobs.jdbc_sink``."""
    risk = C.risk_index(F.col("temp"), F.col("humidity"), F.col("co2"), F.col("alert"))
    scored = readings.withColumn("risk", risk).withColumn("class", C.risk_class(F.col("risk"), F.col("alert"), probable, imminent))
    return scored.writeStream.foreachBatch(jobs.with_metrics("sensors", sink)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

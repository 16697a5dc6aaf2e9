"""Whole jobs on small literal inputs, checked against plain Python or the batch twin."""

from pyspark.sql import functions as F

from sparrowyard import jobs as J
from sparrowyard.functions import udfs
from sparrowyard.operators import reports
from sparrowyard.sources import files
from sparrowyard.streaming import jobs, windows


def put(df, path):
    df.coalesce(1).write.mode("append").parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


def test_log_metrics(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for rep, lag in ((1, 3), (2, 0)):
        (tmp_path / f"in/run-{rep}.txt").write_text(
            "args is set to '/d/g1 10 20 -1 3000 density grasp'\nsubmit --executor-cores 4\n"
            f"24/01/01 00:00:00 INFO 0 5 6 x {1 if lag else 2}.5\n24/01/01 00:00:03 INFO 1 5 6 x 2.5\n24/01/01 00:00:09 WARN other\n"
            "SubgraphOptimization 1 ElapsedTimeMs=7 BestSubgraph=s cost=2.5 nvertices=5 nedges=6\nSubgraphOptimization 0 ElapsedTimeMs=9 BestSubgraph=s cost=2.0 nvertices=4 nedges=6\n"
        )
    J.log_metrics(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    got = {r.repetition: r for r in files.read_csv(spark, str(tmp_path / "out")).collect()}
    assert {k: (r.graph_name, r.num_threads, r.total_time_ms, r.effective_runs, r.cost_best_solution, r.time_to_best_solution_ms) for k, r in got.items()} == {1: ("g1", 4, 9, 2, 2.5, 3000), 2: ("g1", 4, 9, 2, 2.5, 0)}


def test_profile(spark):
    df = spark.createDataFrame([(1, "a", None), (3, "a", None), (None, None, None)], "n int, s string, d date")
    got = {(r.column, r.metric): r.value for r in J.profile(df).collect()}
    assert got["n", "nulls"] == "1" and got["n", "max"] == "3.0" and got["s", "count of a"] == "2" and got["s", "count of null"] == "1" and got["d", "min"] is None
    assert got["n", "ndv"] == "2" and got["s", "ndv"] == "1" and got["s", "sample 1"] == "a"
    assert J.profile(df.limit(0)).where("metric = 'total' and value = '0'").count() == 3


def test_dates_and_lineage(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "1-2", "x"), (2, "2024-01-02", "2024-01-03", "y"), (3, "03/04/2024", "z", "2024-01-01")], "k int, a string, b string, c string")
    assert [tuple(r) for r in reports.date_columns(df, "k").collect()] == [("a", "2024-01-02")]
    assert reports.date_columns(df.limit(0), "k").count() == 0 and reports.date_columns(df.select("k"), "k").count() == 0
    df.write.parquet(f"{tmp_path}/p")
    row = reports.with_lineage(spark.read.parquet(f"{tmp_path}/p")).first()
    assert row.source_file.endswith(".parquet") and row.loaded_at is not None


def test_payments(spark):
    rows = [(1, 1, 2, 0, 500, "TRANSFER"), (2, 2, 3, 10, 600, "TRANSFER"), (3, 3, 1, 20, 700, "TRANSFER"), (4, 2, 1, 30, 900, "TRANSFER"), (5, 9, 9, 31, 5, "PAYMENT")]
    tx = spark.createDataFrame(rows, "tx_id long, orig long, dest long, ms long, amount_cents long, type string")
    out = J.payments(tx, 1000, (2, 100), (3, 100, 800), (100, 1000), F.col("orig") == 2)
    assert {(r.pattern, r.ms, r.accounts, r.amount_cents) for r in out["alerts"].collect()} == {("VELOCITY", 30, "2", 1500), ("CYCLE", 30, "2,1,2", 1400), ("CYCLE", 20, "3,1,2", 1800)}
    assert out["balances"].count() == 4 and out["quality"].first()[:] == (3, 1, 1, 1 / 3, 1.0)
    kept = out["balances"].select("account", "balance_cents")
    assert J.payments(tx, 1000, streamed=kept)["reconciled"].first()[:] == (4, 4, 4, 0, 0, True)
    wrong = kept.where("account <> 9").withColumn("balance_cents", F.col("balance_cents") + F.when(F.col("account") == 2, -7).otherwise(0)).union(spark.createDataFrame([(77, 5)], kept.schema))
    again = J.payments(tx, 1000, streamed=wrong)
    assert again["reconciled"].first()[:] == (4, 4, 5, 3, 7 + 5 + 995, False)
    assert {(r.account, r.a_value, r.b_value, r["diff"]) for r in again["divergent"].collect()} == {(2, kept.where("account = 2").first().balance_cents - 7, kept.where("account = 2").first().balance_cents, -7), (9, None, 995, -995), (77, 5, None, 5)}


def test_blob_etl(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, body in (("cat.1", b"ab"), ("dog.2", b"bad"), ("x", b"c")):
        (tmp_path / "in" / name).write_bytes(body)
    decode = lambda b: b.upper() if b != b"bad" else 1 / 0
    assert J.blob_etl(spark, str(tmp_path / "in"), str(tmp_path / "out"), decode, {"cat": "C", "dog": "D"}, b"\0") == 3
    assert {(r.label, bytes(r.content)) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("C", b"AB"), ("D", b"\0"), (None, b"C")}


def test_bike_trips_and_report(spark):
    row = lambda start, end, station, rider: (["i", "k", start, end, station] + ["v"] * 7 + [rider],)
    rows = [row("2025-02-06 16:00:00", "2025-02-06 16:10:00", s, r) for s, r in (("A", "member"), ("A", "casual"), ("B", "member"), ("C", "member"), ("D", "member"), ("B", "member"), ("C", "casual"))] + [row("bad", "2025-02-06 16:10:00", "", "member")]
    out = J.bike_trips(spark.createDataFrame(rows, "fields array<string>"))
    assert out["counters"].first()[:] == (8, 1, 2, 6) and out["peak_hour"].first()[:] == (16, 7)
    assert {r.rider: r.minutes for r in out["minutes"].collect()} == {"member": 10.0, "casual": 10.0}
    assert {(r.station, r.starting_station_top3) for r in out["trips"].collect()} == {("A", "yes"), ("B", "yes"), ("C", "yes"), ("D", "no"), (None, "no")}
    runs = spark.createDataFrame([("c", 1, 8.0), ("c", 1, 12.0), ("c", 2, 5.0)], "c string, w int, t double")
    got = {r.w: (r.speedup, r.efficiency, r.ci and round(r.ci, 3), r.throughput) for r in J.run_report(runs, "c", "w", "t", 1, F.lit(20.0)).collect()}
    assert got == {1: (1.0, 1.0, 25.412, 2.0), 2: (2.0, 1.0, None, 4.0)}  # t of one degree of freedom is 12.706


def test_taxi_stream(spark, tmp_path):
    raw = spark.range(40).select((F.col("id") * 60).cast("timestamp").alias("tpep_pickup_datetime"), (F.col("id") * 60 + F.col("id") % 5).cast("timestamp").alias("tpep_dropoff_datetime"), (F.col("id") % 2).alias("PULocationID"))
    trips = files.to_canonical(raw, "yellow")
    far = trips.limit(1).withColumn("pickup_datetime", F.lit("2030-01-01").cast("timestamp")).withColumn("trip_duration_s", F.lit(9).cast("bigint"))
    zones = spark.createDataFrame([(0, "Z")], "pu_location_id long, zone string")
    for q in J.taxi_stream(put(trips.union(far), f"{tmp_path}/in"), zones, f"{tmp_path}/out", f"{tmp_path}/ck"):
        q.awaitTermination()
    clean = trips.where("trip_duration_s > 0")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out/counts").collect())) == sorted(map(tuple, windows.counts(clean, "pickup_datetime", ["pu_location_id"], "5 minutes").collect()))
    got = spark.read.parquet(f"{tmp_path}/out/durations")
    assert got.count() and {(r.pu_location_id, r.zone) for r in got.collect()} == {(0, "Z"), (1, None)}


def test_edit_stream(spark, tmp_path):
    rows = [("Q1", "c", "<b>cat</b>", 0), ("File:dog.png", "", "", 6), ("cats", "", "", 0)]
    edits = spark.createDataFrame(rows, "title string, comment string, parsedcomment string, namespace int").withColumn("ts", F.lit("2024-01-01 00:00:01").cast("timestamp"))
    classify = udfs.make_classifier(lambda: lambda texts: [("Cats" if "cat" in t else "Dogs", 1.0) for t in texts])
    J.edit_stream(put(edits, f"{tmp_path}/in"), classify, f"{tmp_path}/t", f"{tmp_path}/ck").awaitTermination()
    assert {(r.category, r.n, r.score) for r in jobs.latest_scores(spark, f"{tmp_path}/t", "start", "n").collect()} == {("Cats", 2, 100.0), ("Dogs", 1, 50.0)}


def test_trade_stream_tells_latency_and_gaps(spark, tmp_path):
    ids = [k for k in range(60) if k not in (7, 8, 30)]
    rows = [(k, "s", 1.0, 2, "buy", 1_700_000_000 + k) for k in ids] + [(99, "s", 1.0, 2, "buy", 1_800_000_000)]
    trades = spark.createDataFrame(rows, "trade_id long, symbol string, price double, qty long, side string, at long").withColumn("ts", F.col("at").cast("timestamp")).drop("at")
    J.trade_stream(put(trades, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck", "20 seconds", metrics=f"{tmp_path}/m").awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/out")
    assert found.agg(F.sum("trades")).first()[0] == 57
    sink = jobs.candle_sink(f"{tmp_path}/o2", f"{tmp_path}/m2", "symbol", clock=lambda: 1_700_000_100.0)
    for _ in range(2):  # a batch that comes again
        sink(found.drop("batch"), 3)
    row = spark.read.parquet(f"{tmp_path}/m2").first()
    waits = sorted(1_700_000_100_000 - r.mean_ms for r in found.collect())
    assert (row.candles, row.trades, row.gaps) == (len(waits), 57, 3) and row.batch == 3
    assert abs(row.latency_ms - sum(waits) / len(waits)) < 1e-6 and row.p50_ms == waits[len(waits) // 2] if len(waits) % 2 else True
    assert spark.read.parquet(f"{tmp_path}/m").agg(F.sum("trades")).first()[0] == 57


def test_trade_stream_and_indicators(spark, tmp_path):
    trades = spark.range(61).select(F.col("id").alias("trade_id"), F.lit("s").alias("symbol"), (F.col("id") % 7 + 1.0).alias("price"), F.lit(1).alias("qty"), F.lit("buy").alias("side"), (F.col("id") * 60 + F.when(F.col("id") == 60, 10**6).otherwise(0)).cast("timestamp").alias("ts"))
    J.trade_stream(put(trades, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    closes = [i % 7 + 1.0 for i in range(60)][-50:]
    ema = closes[0]
    for x in closes[1:]:
        ema = ema * 0.8 + x * 0.2
    got = J.candle_indicators(spark, f"{tmp_path}/out").first()
    assert abs(got.ema - ema) < 1e-9 and 0 < got.rsi < 100


def test_sensor_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, 50.0, 40.0, 450.0, False), (2, 20.0, 50.0, 400.0, True), (3, 20.0, 50.0, 400.0, False)], "id int, temp double, humidity double, co2 double, alert boolean")
    sink = windows.upsert_latest(f"{tmp_path}/t", ["id"], "risk")
    J.sensor_stream(put(rows, f"{tmp_path}/in"), sink, f"{tmp_path}/ck").awaitTermination()
    assert {r.id: (r.risk, r["class"]) for r in windows.snapshot(spark, f"{tmp_path}/t").collect()} == {1: (80.0, "high"), 2: (100.0, "high"), 3: (0.0, "none")}

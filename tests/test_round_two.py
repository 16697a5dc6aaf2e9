"""Profiles, run figures, longer cycles, restarts, idle drains, and loops that must not stop early."""

import random
import socket
import threading
import time

import pytest
from pyspark.sql import functions as F

from sparrowyard.operators import graph, ledger
from sparrowyard.operators import relational as R
from sparrowyard.session import shared_dir
from sparrowyard.sources import files
from sparrowyard.streaming import jobs, state, windows


def test_unique_values_and_counts(spark):
    rows = [(f"v{i:04}", i % 7, None, i % 25) for i in range(3000)]
    df = spark.createDataFrame(rows, "many string, few long, none string, some long")
    got = {r.column: (r.listed, r.ndv, r["values"]) for r in R.unique_values(df, df.columns).collect()}
    assert got["few"] == (True, 7, [str(i) for i in range(7)]) and got["none"] == (True, 0, [])
    assert got["some"][0] is False and got["some"][2] == sorted(map(str, range(25)))[:5]
    assert got["many"][2] == ["v0000", "v0001", "v0002", "v0003", "v0004"] and abs(got["many"][1] - 3000) < 300
    counts = R.value_counts(df, df.columns, 25)
    assert {r.column for r in counts.select("column").distinct().collect()} == {"few", "none", "some"} and counts.where("column = 'some'").count() == 25
    assert R.value_counts(df.select("many"), ["many"], 25).count() == 0 and R.value_counts(df.limit(0), ["few"]).count() == 0


def test_approximate_counts_are_near(spark):
    df = spark.range(20_000).select((F.col("id") % 7001).alias("a"))
    assert abs(R.approx_distinct(df, {"a": "a"}).first().a - 7001) < 0.15 * 7001
    one = R.numeric_profile(df, ["a"]).first()
    assert abs(one.ndv - 7001) < 0.15 * 7001 and R.numeric_profile(df, ["a"], exact=True).first().ndv == 7001


def test_quantile_of_buckets(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 101)] + [("b", 1000.0), ("c", None)], "k string, v double")
    got = {r.k: r.quantile for r in R.bucket_quantile(R.bucket_histogram(df, ["k"], "v", [10.0, 50.0, 100.0, float("inf")]), ["k"], 0.9).collect()}
    assert got == {"a": 90.0, "b": 100.0, "c": None}


def test_gaps_with_repeats_and_nulls(spark):
    df = spark.createDataFrame([("a", i) for i in (1, 2, 2, 5, 9, None)] + [("b", 4)], "k string, id long")
    assert {r.k: (r.missing, r.gaps) for r in R.id_gaps(df, "k", "id").collect()} == {"a": (5, 2), "b": (0, 0)}


def test_membership(spark):
    ids = spark.createDataFrame([(1,), (2,), (None,)], "id long")
    keep = spark.createDataFrame([(2,), (2,), (None,)], "x long")
    assert [r.id for r in R.keep_in(ids, "id", keep).collect()] == [2]
    assert {r.id for r in R.unseen(ids, keep.withColumnRenamed("x", "id"), "id").collect()} == {1, None}


def test_cycles_of_any_length(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(6), rng.randrange(6), rng.randrange(3000), rng.randrange(1, 50)) for i in range(60)]
    tx = spark.createDataFrame(rows, "tx_id long, orig long, dest long, ms long, amount_cents long")
    found = lambda df: sorted(tuple(r.tx_ids) for r in df.collect())
    assert found(ledger.temporal_cycles(tx, 2, 900, 10)) == sorted((r.tx1, r.tx2) for r in ledger.cycles(tx, 900, 10).collect())
    assert found(ledger.temporal_cycles(tx, 3, 900, 10)) == sorted((r.tx1, r.tx2, r.tx3) for r in ledger.cycles3(tx, 900, 10).collect())
    want = []
    for last in rows:
        near = [r for r in rows if last[3] - 900 <= r[3] <= last[3]]
        for x in near:
            for y in near:
                for z in near:
                    walk = [last[1], last[2], x[2], y[2]]
                    if len({*walk}) == 4 and (x[1], y[1], z[1], z[2]) == (last[2], x[2], y[2], last[1]) and sum(t[4] for t in (last, x, y, z)) >= 10:
                        want.append((x[0], y[0], z[0], last[0]))
    assert found(ledger.temporal_cycles(tx, 4, 900, 10)) == sorted(want)
    with pytest.raises(ValueError):
        ledger.temporal_cycles(tx, 1)


def test_loops_raise_when_unfinished(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(64)], "src long, dst long")
    with pytest.raises(graph.NotConverged):
        graph.connected_components(e, max_iter=1)
    with pytest.raises(graph.NotConverged):
        graph.shortest_paths(e.withColumn("w", F.lit(1.0)), spark.createDataFrame([(0,)], "id long"), max_iter=3)
    report = graph.component_report(e.union(spark.createDataFrame([(100, 101), (100, 100)], "src long, dst long"))).first()
    assert (report.nodes, report.kept, report.dropped, report.edges) == (67, 65, 2, 64)


def test_missing_lines_of_json_are_no_rows(spark, tmp_path):
    assert files.read_ndjson(spark, str(tmp_path / "none.json"), "a int").count() == 0
    (tmp_path / "some.json").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r.a for r in files.read_ndjson(spark, str(tmp_path / "s*.json"), "a int").collect()) == [1, 2]


def test_failed_query_goes_on_from_its_checkpoint(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(30).write.parquet(src)
    failures = [1]

    def start(checkpoint):
        def put(batch, i):
            if failures:
                failures.pop()
                raise RuntimeError("down")
            batch.write.mode("overwrite").parquet(f"{out}/b={i}")

        return spark.readStream.schema("id long").parquet(src).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    jobs.restartable(start, str(tmp_path / "ckpt"))
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(30)) and not failures
    failures += [1, 1]
    spark.range(5).write.mode("append").parquet(src)
    with pytest.raises(Exception):
        jobs.restartable(start, str(tmp_path / "ckpt"), attempts=2)
    jobs.restartable(start, str(tmp_path / "ckpt"))
    assert spark.read.parquet(out).count() == 35


def test_idle_account_is_drained(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rng = random.Random(5)
    rows = [(i, i * 100 + rng.randrange(300), i % 3, rng.choice([-1, 1]) * rng.randint(1, 400), "x") for i in range(60)]
    schema = "tx_id long, ms long, account long, delta_cents long, kind string"
    ops = spark.createDataFrame(rows, schema)
    ops.coalesce(1).write.parquet(src)
    try:
        stream = state.settle_when_idle(spark.readStream.schema(schema).parquet(src), delay_ms=500, idle_ms=2000, opening=300)
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(processingTime="500 milliseconds").start()
        until, seen = time.time() + 60, 0
        while seen < 60 and time.time() < until:
            time.sleep(1)
            seen = spark.read.schema(stream.schema).parquet(out).count() if files.exists(spark, f"{out}/_spark_metadata/*") else 0
        query.stop()
        got = {r.tx_id: (r.status, r.balance_cents, r.apply_seq) for r in spark.read.parquet(out).collect()}
        assert got == {r.tx_id: (r.status, r.balance_cents, r.apply_seq) for r in ledger.settle(ops, 300).collect()}
    finally:
        spark.conf.set(key, old) if old else spark.conf.unset(key)


def test_socket_and_console(spark):
    server = socket.create_server(("127.0.0.1", 0))

    def feed():
        conn, _ = server.accept()
        conn.sendall(b"to be\nor not to be\n")
        time.sleep(60)
        conn.close()

    threading.Thread(target=feed, daemon=True).start()
    lines = files.read_socket(spark, "127.0.0.1", server.getsockname()[1])
    query, seen, until = jobs.start_console(lines, truncate=False, seconds=1), 0, time.time() + 40
    while seen < 2 and time.time() < until:
        time.sleep(0.5)
        seen = sum(p.numInputRows for p in query.recentProgress)
    query.stop()
    server.close()
    assert seen == 2


def test_shared_folder_and_days(spark):
    assert shared_dir(spark) == shared_dir(spark)
    df = spark.createDataFrame([("2024-01-01 10:00:00", 1, 90.0), ("2024-01-01 12:00:00", 1, 150.0), ("2024-01-02 00:00:00", 2, 10.0), (None, 2, 1.0)], "t string, zone long, s double")
    trips = windows.with_event_time(df, "t", "1 minute")
    assert sorted((str(r.start)[:10], r.n) for r in jobs.daily_peaks(trips, "t").collect()) == [("2024-01-01", 2), ("2024-01-02", 1)]
    zones = spark.createDataFrame([(1, "A")], "zone long, name string")
    assert sorted((r.zone, r["mean"], r.n, r.name) for r in jobs.avg_by_zone(trips, "t", "zone", "s", zones).collect()) == [(1, 2.0, 2, "A"), (2, 0.17, 1, None)]


@pytest.mark.parametrize("block", [3, 2000])
def test_collaborative_matches_plain_loop(spark, block):
    from sparrowyard.operators import recommend

    rng = random.Random(8)
    rated = {(rng.randrange(12), rng.randrange(9)): float(rng.randint(2, 5)) for _ in range(60)}
    rated |= {(u, 0): 5.0 for u in range(12)}  # an item that all like
    df = spark.createDataFrame([(u, i, r) for (u, i), r in rated.items()], "user long, item long, rating double")
    likes = {k: r for k, r in rated.items() if r >= 4}
    want = []
    for u in range(12):
        shared = {o: n for o in range(12) if o != u and (n := sum((o, i) in likes for i in range(9) if (u, i) in likes))}
        scored = []
        for i in range(9):
            by = [o for o in shared if (o, i) in likes]
            if by and (u, i) not in rated:
                scored.append((-len(by), -round(sum(likes[o, i] * shared[o] for o in by) / sum(shared[o] for o in by), 6), i))
        want += [(u, i, -n, -m, k) for k, (n, m, i) in enumerate(sorted(scored)[:3], 1)]
    got = recommend.collaborative(df, df.select("user").distinct(), 3, block=block).collect()
    assert sorted((r.user, r.item, r.similar_users, round(r.mean_rating, 6), r["rank"]) for r in got) == sorted(want)

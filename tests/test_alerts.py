"""Alert ids, one alert a minute, and cycles on streams: equal to the batch over several micro-batches and a restart."""

import hashlib
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparrowyard.operators import alerts, ledger
from sparrowyard.streaming import alerts as stream

TX = "tx_id long, orig long, dest long, ms long, amount_cents long, type string"
RULES = {"velocity": (4, 60_000), "structuring": (3, 300_000, 500)}


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def made(seed, n, accounts, gap):
    rng = random.Random(seed)
    ms, out = 1_700_000_000_000, []
    for k in range(n):
        ms += rng.randrange(gap)
        out.append((k, rng.randrange(accounts), rng.randrange(accounts), ms, rng.randint(1, 900), rng.choice(["TRANSFER", "TRANSFER", "PAYMENT"])))
    return out


def by_hand(rows, velocity, structuring, cycle=None):
    """Hits in order, then the first of each id."""
    hits = []
    for tx, orig, dest, ms, amount, kind in rows:
        near = [r for r in rows if r[1] == orig and ms - velocity[1] <= r[3] <= ms]
        if len(near) >= velocity[0]:
            hits.append((ms, [tx], "VELOCITY", str(orig), sum(r[4] for r in near), len(near)))
        small = [r for r in rows if r[1] == orig and ms - structuring[1] <= r[3] <= ms and r[5] == "TRANSFER" and r[4] < structuring[2]]
        if kind == "TRANSFER" and amount < structuring[2] and len(small) >= structuring[0]:
            hits.append((ms, [tx], "STRUCTURING", str(orig), sum(r[4] for r in small), len(small)))
        if cycle and kind == "TRANSFER" and orig != dest:
            recent = [r for r in rows if r[5] == "TRANSFER" and r[1] != r[2] and ms - cycle[0] <= r[3] <= ms and r[0] != tx]
            for x in recent:
                if x[1] != dest:
                    continue
                if x[2] == orig and amount + x[4] >= cycle[1]:
                    hits.append((ms, [tx, x[0]], "CYCLE", f"{orig},{dest},{orig}", amount + x[4], 2))
                for y in recent:
                    if x[2] != orig and y[1] == x[2] and y[2] == orig and amount + x[4] + y[4] >= cycle[1]:
                        hits.append((ms, [tx, x[0], y[0]], "CYCLE", f"{orig},{dest},{x[2]}", amount + x[4] + y[4], 3))
    first = {}
    for ms, ids, pattern, accounts, amount, n in sorted(hits):
        key = hashlib.sha1(f"{pattern}|{accounts}|{ms // 60_000}".encode()).hexdigest()[:16]
        first.setdefault(key, (key, pattern, accounts, ms // 60_000, ms, amount, n))
    return sorted(first.values())


def test_alerts_have_ids_and_come_once_a_minute(spark):
    rows = made(1, 220, 6, 20_000)
    got = alerts.alerts(spark.createDataFrame(rows, TX).repartition(4), **RULES, cycle=(120_000, 900))
    want = by_hand(rows, *RULES.values(), (120_000, 900))
    assert sorted(map(tuple, got.collect())) == want and {w[1] for w in want} == {"VELOCITY", "STRUCTURING", "CYCLE"}
    assert got.columns == alerts.ALERT and len({w[0] for w in want}) == len(want)
    assert alerts.alerts(spark.createDataFrame([], TX), **RULES).count() == 0


def folder(spark, rows, at, name):
    spark.createDataFrame(rows, TX).coalesce(1).write.mode("append").parquet(f"{at}/{name}")


def reader(spark, at):
    return spark.readStream.schema(TX).option("maxFilesPerTrigger", 1).parquet(f"{at}/*")


def test_burst_stream_equals_batch_and_ignores_repeats(rocks, tmp_path):
    rows = made(2, 150, 3, 20_000)
    for k in range(3):
        part = rows[50 * k : 50 * k + 50]
        folder(rocks, part + part[-5:], tmp_path / "in", f"part{k}")  # some transactions come twice
    found = stream.burst_stream(reader(rocks, tmp_path / "in"), **RULES)
    out = str(tmp_path / "out")

    def run():
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()

    run()
    folder(rocks, rows[-20:], tmp_path / "in", "part3")  # a replay after a restart adds none
    run()
    assert sorted(map(tuple, rocks.read.parquet(out).collect())) == by_hand(rows, *RULES.values())


@pytest.mark.parametrize("batches", [1, 4])
def test_cycle_stream_equals_batch_over_a_restart(spark, tmp_path, batches):
    rows = [r for r in made(3, 260, 14, 9_000) if r[5] == "TRANSFER"]
    rng = random.Random(batches)
    late = sorted(rows, key=lambda r: r[3] + rng.randrange(30_000))  # out of order over batches
    at, rules = tmp_path / "in", {"span": 120_000, "min_total": 700}
    size = -(-len(late) // batches)
    edges, out, ck = (str(tmp_path / n) for n in ("edges", "out", "ck"))
    for k in range(batches):
        folder(spark, late[k * size : (k + 1) * size], at, f"part{k}")
        if k % 2:  # a restart after every other file
            stream.start_cycles(reader(spark, at), edges, out, ck, **rules).awaitTermination()
    stream.start_cycles(reader(spark, at), edges, out, ck, **rules).awaitTermination()
    batch = spark.createDataFrame(rows, TX)
    want = sorted(map(tuple, ledger.cycles(batch, 120_000, 700).select("tx1", "tx2").collect())) + sorted(map(tuple, ledger.cycles3(batch, 120_000, 700).select("tx1", "tx2", "tx3").collect()))
    got = [tuple(r.tx_ids[1:]) + (r.tx_ids[0],) for r in spark.read.parquet(out).collect()]
    assert sorted(got, key=lambda x: (len(x), x)) == sorted(want, key=lambda x: (len(x), x)) and len({len(w) for w in want}) == 2
    expected = alerts.first_of_minute(alerts.cycle_hits(batch, 120_000, 700))
    assert sorted(map(tuple, stream.cycle_alerts(spark, out).collect())) == sorted(map(tuple, expected.collect()))


def test_a_batch_that_comes_again_changes_nothing_and_old_edges_leave(spark, tmp_path):
    rows = [r for r in made(4, 200, 8, 9_000) if r[5] == "TRANSFER"]
    put = stream.cycle_sink(spark, str(tmp_path / "edges"), str(tmp_path / "out"), 60_000, 500)
    df = spark.createDataFrame(rows, TX).withColumn("k", F.ntile(5).over(Window.orderBy("ms")))
    parts = [df.where(F.col("k") == k).drop("k").cache() for k in range(1, 6)]
    for k, p in enumerate(parts):
        put(p, k)
    before = sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect()))
    put(parts[4], 4)
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect())) == before
    held = stream.EdgeTable(spark, str(tmp_path / "edges"), 60_000, 2).buckets(99)
    assert 0 not in held and 4 in held

"""Streams with state, sinks, readers and jobs, on small literal inputs."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from sparrowyard.functions import columns as C
from sparrowyard.functions import udfs
from sparrowyard.operators import graph, ledger, recommend
from sparrowyard.operators import relational as R
from sparrowyard.operators import reports as P
from sparrowyard.sources import files, sinks
from sparrowyard.streaming import jobs, state, windows


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def fed(spark, df, parts, path, order):
    """A file stream of df, dealt to files in the given order."""
    rows = df.orderBy(order).collect()
    n = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * n : (i + 1) * n], df.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def ran(df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_settle_stream_equals_batch(rocks, tmp_path):
    rng = random.Random(3)
    ops = [(k, 1_700_000_000_000 + k * 200 + rng.randrange(2000), rng.randrange(4), rng.choice([-1, 1]) * rng.randint(1, 400), rng.choice(["credit", "debit"])) for k in range(200)]
    schema = "tx_id long, ms long, account long, delta_cents long, kind string"
    batch = rocks.createDataFrame(ops, schema)
    flush = rocks.createDataFrame([(9999, 1_900_000_000_000, 99, 1, "credit")], schema)
    stream = fed(rocks, batch.union(flush), 3, str(tmp_path / "in"), "tx_id")
    got = ran(state.settle_stream(stream, "5 seconds", 500), "settled", tmp_path)
    want = ledger.settle(batch, 500)
    cols = ["account", "apply_seq", "tx_id", "status", "balance_cents"]
    assert sorted(map(tuple, got.where("account < 99").select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_beats_drain_an_idle_ledger(rocks, tmp_path):
    schema = "tx_id long, ms long, account long, delta_cents long, kind string"
    ops = rocks.createDataFrame([(1, 1_000_000, 5, -3, "debit"), (2, 1_000_500, 5, 4, "credit"), (3, 1_000_700, None, 4, "credit")], schema)
    beats = rocks.createDataFrame([(1_000_000,), (1_040_000,)], "ms long")
    stream = fed(rocks, ops, 1, str(tmp_path / "in"), "tx_id")
    clock = fed(rocks, beats, 2, str(tmp_path / "beats"), "ms")
    got = ran(state.settle_stream(stream, "5 seconds", 10, clock), "drained", tmp_path)
    assert sorted((r.tx_id, r.balance_cents, r.apply_seq) for r in got.collect()) == [(1, 7, 1), (2, 11, 2)]
    assert state.clock(rocks).isStreaming and state.clock(rocks).columns == ["ms"]


def test_aml_stream_equals_batch(rocks, tmp_path):
    rng = random.Random(5)
    rows = [(k, rng.randrange(3), k * 1000 + 5, rng.randint(1, 90)) for k in range(120)]
    batch = rocks.createDataFrame(rows, "tx_id long, orig long, ms long, amount_cents long")
    got = ran(state.aml_stream(fed(rocks, batch, 3, str(tmp_path / "in"), "ms"), 5, 12_000), "aml", tmp_path)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ledger.velocity(batch, 5, 12_000).collect())) != []


def test_candle_stream_equals_batch(spark, tmp_path):
    rows = spark.range(60).select(F.col("id").alias("trade_id"), F.lit("a").alias("symbol"), (F.col("id") * 1.5).alias("price"), F.lit(2).alias("qty"), F.lit("buy").alias("side"), (F.col("id") * 60).cast("timestamp").alias("ts"))
    late = rows.limit(1).withColumn("ts", F.lit("2030-01-01").cast("timestamp"))
    stream = fed(spark, rows.union(late), 2, str(tmp_path / "in"), "ts")
    got = ran(jobs.candles(stream, "ts", "symbol", "10 minutes", "1 minute"), "candles", tmp_path)
    want = jobs.candles(rows, "ts", "symbol", "10 minutes", "1 minute")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_words_and_meanings(spark, tmp_path):
    schema = "user_id int, value string"
    lines = spark.createDataFrame([(1, "b a x"), (2, "a"), (3, None), (4, "")], schema)
    meanings = spark.createDataFrame([("a", "A"), ("b", "B")], "word string, meaning string")
    stream = fed(spark, lines, 1, str(tmp_path / "in"), "user_id")
    got = {r.word: r.users for r in ran(jobs.users_of_words(jobs.attach_meaning(jobs.words_of(stream), meanings)), "words", tmp_path, "complete").collect()}
    assert got == {"a": [1, 2], "b": [1]}
    assert {r.user_id: r.meanings for r in jobs.meanings_per_request(jobs.words_of(lines), meanings, ["user_id"]).collect()} == {1: ["B", "A"], 2: ["A"]}


def test_orders_of_rows(spark, tmp_path):
    df = spark.createDataFrame([("a", 3, 1), ("a", 1, 2), ("b", 2, 3), ("b", None, 4), ("a", 3, 5)], "file string, ts int, id int")
    assert [r.id for r in R.newest(df, "ts", "id", 3).collect()] == [5, 1, 3]
    assert [r.id for r in R.head(df, 2, "id").collect()] == [1, 2] and R.head(df, 9).count() == 5
    rows = [(r.file, r.id) for r in R.sort_within(df.where("ts is not null"), "file", "ts", "id").collect()]
    assert [i for f, i in rows if f == "a"] == [2, 1, 5] and [i for f, i in rows if f == "b"] == [3]
    stream = fed(spark, df, 1, str(tmp_path / "in"), "id")
    job = lambda x: jobs.sorted_complete(x.groupBy("file").agg(F.count("*").alias("n")), F.desc("n"))
    assert [tuple(r) for r in ran(job(stream), "counted", tmp_path, "complete").collect()] == [("a", 3), ("b", 2)]


def test_trailing_counts_across_periods(spark):
    rows = [(k, 1 if k % 3 else 2, (k * 37) % 500 - 50, k) for k in range(150)]
    got = {r.id: (r.n_trailing, r.sum_trailing) for r in R.trailing(spark.createDataFrame(rows, "id int, g int, ms long, v int"), "g", "ms", 60, "v").collect()}
    for k, g, ms, _ in rows:
        near = [v for _, h, t, v in rows if h == g and ms - 60 <= t <= ms]
        assert got[k] == (len(near), sum(near))


def test_orders_latency_and_options(spark):
    schema = "id int, items array<struct<name: string, n: int>>"
    df = spark.createDataFrame([('{"id": 1, "items": [{"name": "p", "n": 2}, {"name": "q", "n": 1}]}',), ('{"id": 2}',), ("{broken",)], "value string")
    assert sorted(map(tuple, jobs.flatten_orders(df, schema, "items").collect()), key=str) == [(1, "p", 2), (1, "q", 1), (2, None, None)]
    t = spark.sql("select 'k' as k, timestamp'2024-01-01 00:00:00' as a, timestamp'2024-01-01 00:00:01.5' as b")
    assert jobs.latency(t, "a", "b", ["k"]).first().p50 == 1500.0
    assert jobs.rate_limit(5000) == {"maxOffsetsPerTrigger": "5000"} and jobs.rate_limit(3, "file") == {"maxFilesPerTrigger": "3"}
    assert files.kafka_options("h:1", "t", per_trigger=9)["maxOffsetsPerTrigger"] == "9"


def test_two_jobs_progress_and_idle_stop(spark, tmp_path):
    rows = spark.range(50).select((F.col("id") * 60).cast("timestamp").alias("ts"), "id")
    rows.write.parquet(f"{tmp_path}/in")
    listener = jobs.ProgressListener(f"{tmp_path}/progress.jsonl")
    spark.streams.addListener(listener)
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    seen = []
    put = jobs.with_metrics("up", windows.upsert_latest(f"{tmp_path}/t", ["id"], "ts"), seen.append)
    live = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{tmp_path}/ck3").start()
    queries = jobs.start_all({"even": stream.where("id % 2 = 0"), "odd": stream.where("id % 2 = 1")}, f"{tmp_path}/out", f"{tmp_path}/ck")
    assert jobs.run_until_idle([live, *queries], polls=2, every=0.5, timeout=120)
    spark.streams.removeListener(listener)
    assert spark.read.parquet(f"{tmp_path}/out/even").count() == spark.read.parquet(f"{tmp_path}/out/odd").count() == 25
    assert seen[0]["rows"] == 50 and windows.snapshot(spark, f"{tmp_path}/t").count() == 50
    lines = [json.loads(x) for x in open(f"{tmp_path}/progress.jsonl")]
    assert sum(x["numInputRows"] for x in lines) >= 100


def test_upsert_if_newer_and_scores(spark, tmp_path):
    put = jobs.upsert_if_newer(str(tmp_path / "a"), ["k"], "seq")
    put(spark.createDataFrame([(1, 5, "new")], "k int, seq long, v string"), 0)
    put(spark.createDataFrame([(1, 4, "old"), (2, 1, "x")], "k int, seq long, v string"), 1)
    assert {r.k: r.v for r in windows.snapshot(spark, str(tmp_path / "a")).collect()} == {1: "new", 2: "x"}
    put = jobs.latest_window_sink(str(tmp_path / "b"), ["c"], "w", "n", "n")
    put(spark.createDataFrame([(1, "a", 9), (2, "a", 4), (2, "b", 1)], "w int, c string, n long"), 0)
    assert {(r.c, r.score) for r in jobs.latest_scores(spark, str(tmp_path / "b"), "w", "n").collect()} == {("a", 100.0), ("b", 25.0)}


def test_readers(spark, tmp_path):
    with gzip.open(tmp_path / "w.csv.gz", "wt") as f:
        f.write("one\ntwo\n")
    assert [r.word for r in files.read_words(spark, str(tmp_path / "w.csv.gz")).collect()] == ["one", "two"]
    (tmp_path / "t.csv").write_text("a,b\n1,x\n2,y\n")
    assert files.read_csv(spark, str(tmp_path / "t.csv")).dtypes == [("a", "int"), ("b", "string")]
    (tmp_path / "s.csv").write_text("h1,h2\n1,2\n1\n3,\n")
    assert sorted(r.fields for r in files.read_csv_strict(spark, [str(tmp_path / "s.csv")], 2).collect()) == [["1", "2"], ["3", ""]]
    (tmp_path / "n.json").write_text('{"a": 1}\n{"a": 2}\n')
    assert files.read_ndjson(spark, str(tmp_path / "n.json"), "a int").count() == 2
    (tmp_path / "arr.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert files.read_json_array(spark, str(tmp_path / "arr.json"), "a int").count() == 2
    (tmp_path / "doc.json").write_text('{"rows": [{"a": 1},\n {"a": 2}]}')
    assert [r.a for r in files.read_json_doc(spark, str(tmp_path / "doc.json"), "rows").collect()] == [1, 2]
    (tmp_path / "g.graphml").write_text(
        '<graphml><key id="d1" for="edge" attr.name="length"/><key id="d2" for="node" attr.name="y"/><graph>'
        '<node id="a"><data key="d2">1.5</data></node><node id="b"><data key="d2">2</data></node>'
        '<edge source="a" target="b"><data key="d1">3</data></edge><edge source="a" target="b"><data key="d1">3</data></edge>'
        '<edge source="a" target="z"><data key="d1">3</data></edge><edge source="b" target="a"><data key="d1">0</data></edge></graph></graphml>'
    )
    v, e = files.read_graphml(spark, str(tmp_path / "g.graphml"))
    assert sorted((r.ext, r.lat) for r in v.collect()) == [("a", 1.5), ("b", 2.0)]
    assert [tuple(r) for r in e.collect()] == [("a", "b", 3.0, 3.0)] * 2


def test_layouts_and_labels(spark):
    assert [files.infer_layout(p) for p in ("x/fhvhv_tripdata.parquet", "fhv_1", "Yellow_2", "other")] == ["fhvhv", "fhv", "yellow", None]
    df = spark.createDataFrame([("d/Cat.1.jpg",), ("d/dog.2.jpg",), ("d/x",)], "path string")
    assert [r[0] for r in df.select(files.label_from_name(F.col("path"), {"cat": "CAT", "dog": "DOG"})).collect()] == ["CAT", "DOG", None]


def test_sinks(spark, tmp_path):
    df = spark.range(25).withColumn("v", F.col("id") % 3)
    sinks.write_csv(df, f"{tmp_path}/c")
    assert files.read_csv(spark, f"{tmp_path}/c").count() == 25
    assert sinks.write_parquet_checked(df, f"{tmp_path}/p") == 25
    report = sinks.csv_to_parquet(spark, f"{tmp_path}/c", f"{tmp_path}/q", 10).collect()
    assert len(report) >= 3 and all(r.bytes > 0 for r in report) and spark.read.parquet(f"{tmp_path}/q").count() == 25
    put = jobs.jdbc_sink(f"jdbc:derby:memory:{tmp_path.name};create=true", "t", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    put(df, 0)
    assert spark.read.jdbc(f"jdbc:derby:memory:{tmp_path.name}", "t", properties={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}).count() == 25
    for i in range(4):
        (tmp_path / f"f{i}.csv").write_text("a\n" + "1\n" * 10)
    chosen = sinks.files_to_size(spark, str(tmp_path), "f*.csv", 30)
    assert [r.path.rsplit("/", 1)[1] for r in chosen.orderBy("path").collect()] == ["f0.csv", "f1.csv"]
    assert sinks.concat_to_size(spark, str(tmp_path), "f*.csv", f"{tmp_path}/big", 30) == 20


def test_udfs(spark):
    udfs.register_udfs(spark)
    assert spark.sql("select initials('ada king') as a, initials(null) as b").first() == ("AK", None)
    assert spark.createDataFrame([("ada king",), (None,)], "s string").select(C.initials(F.col("s"))).collect()[0][0] == "AK"
    score = udfs.make_classifier(lambda: lambda texts: [("Short" if len(t) < 4 else "Long", 0.5) for t in texts])
    got = [r[0] for r in spark.createDataFrame([("abc",), ("abcdef",), ("",), (None,)], "s string").select(score("s")).collect()]
    assert got == ["Short|0.5", "Long|0.5", "Others|0.0", "Others|0.0"]
    assert C.split_label and spark.createDataFrame([("a|0.5",)], "s string").select(C.split_label(F.col("s")).alias("x")).first().x == ("a", 0.5)
    decode = udfs.make_decoder(lambda b: bytes(reversed(b)) if b != b"bad" else 1 / 0, b"\0" * 4)
    assert [bytes(r[0]) for r in spark.createDataFrame([(b"ab",), (b"bad",)], "b binary").select(decode("b")).collect()] == [b"ba", b"\0" * 4]
    one = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0], 1.0, 1.0 + 1e-9)], "a array<double>, b array<double>, x double, y double")
    assert one.select(C.cosine(F.col("a"), F.col("b")), C.near(F.col("x"), F.col("y"))).first() == (1.0, True)


def test_nearest_category_edges(spark):
    cats = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "name string, vec array<double>")
    rows = spark.createDataFrame([(1, [2.0, 1.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 1.0])], "id int, v array<float>")
    got = {r.id: r.category for r in P.nearest_category(rows, "v", cats).collect()}
    assert got == {1: "x", 2: None, 3: None, 4: "x"}
    assert P.nearest_category(rows, "v", cats.limit(0)).where("category is null").count() == 4
    with pytest.raises(ValueError):
        P.nearest_category(rows, "v", cats, limit=1)


def test_bfs_sample_pregel_and_load(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(0, i) for i in range(2, 20)] + [(100, 101)]
    e = spark.createDataFrame(pairs, "src long, dst long")
    got = {r.id for r in graph.bfs_sample(e, 0, 25, 7).collect()}
    assert len(got) == int(43 * 0.25) and 0 in got and got == {r.id for r in graph.bfs_sample(e, 0, 25, 7).collect()}
    assert got <= set(range(20))
    assert len(graph.bfs_sample(e, 100, 90).collect()) == 2
    kept = graph.node_set(graph.load_graph(e, pct=25, start=0)).count()
    assert 1 < kept <= 10 and graph.node_set(graph.load_graph(e)).count() == 41 and graph.node_set(graph.load_graph(e, whole=True)).count() == 43
    v = graph.node_set(graph.clean_edges(e, False)).withColumn("state", F.col("id"))
    low = graph.pregel(v, graph.clean_edges(e, False), lambda s: s, F.min, lambda s, m: F.least(s, m), 60)
    assert {r.state for r in low.collect()} == {0, 100}


def test_global_rank_is_total(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    assert all(r["rank"] == r.x + 1 for r in graph.global_rank(df, [F.col("x")]).collect())
    assert graph.global_rank(df.limit(0), [F.col("x")]).count() == 0


def test_empty_inputs(spark):
    alerts = spark.createDataFrame([], "accounts string")
    truth = spark.createDataFrame([], "account string")
    assert P.precision_recall(alerts, "accounts", truth).first()[:] == (0, 0, 0, 0.0, 0.0)
    with pytest.raises(ValueError):
        P.amplify(truth, 0, ["account"])
    assert P.amplify(spark.createDataFrame([("a",), ("",), (None,)], "k string"), 2, ["k"]).where("k = 'a#1'").count() == 1
    movies = spark.createDataFrame([(1, "old", "A|B", 0), (1, "new", "B", 1)], "item int, title string, genres string, at int")
    tags = spark.createDataFrame([(1, "t", 0.1, 0), (2, "t", 0.2, 0)], "item int, tag string, score double, at int")
    made = recommend.build_catalog(movies, tags)
    assert made["item"].first().title == "new" and {r.label: r.n for r in recommend.catalog_counts(made).collect()} == {"item": 1, "genre": 1, "tag": 1, "has_genre": 1, "has_tag": 1}

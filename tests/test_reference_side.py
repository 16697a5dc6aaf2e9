"""Operators outside the training-data subpackage, on literal inputs."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from sparrowyard.operators import graph, ledger, recommend
from sparrowyard.operators import relational as R
from sparrowyard.sources import files
from sparrowyard.streaming import windows


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def test_entry_imports():
    import __spark_entry__ as entry

    assert "weapon_effectiveness" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("pairs,rounds,want,converged", [([(1, 0), (2, 0)], 1, {0: 1}, False), ([(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3)], 10, {}, None)])
def test_label_propagation(spark, pairs, rounds, want, converged):
    labels, _, done = graph.label_propagation(graph.clean_edges(edges(spark, pairs), directed=False), rounds)
    got = {r.id: r.label for r in labels.collect()}
    assert all(got[k] == v for k, v in want.items()) and (converged is None or done == converged)
    assert set(got) == {x for p in pairs for x in p}


def test_loops_only_is_empty(spark):
    assert graph.node_set(graph.clean_edges(edges(spark, [(1, 1), (2, 2)]))).count() == 0


def test_components_and_largest(spark):
    e = edges(spark, [(i, i + 1) for i in range(30)] + [(100, 101)])
    assert {r.id for r in graph.largest_component(e).collect()} == set(range(31))


def test_shortest_paths_match_dijkstra(spark):
    rng = random.Random(4)
    arcs = {(rng.randrange(25), rng.randrange(25)): float(rng.randint(1, 9)) for _ in range(70)}
    e = spark.createDataFrame([(a, b, w) for (a, b), w in arcs.items()], "src long, dst long, w double")
    got = {(r.source, r.node): r.dist for r in graph.shortest_paths(e, spark.createDataFrame([(0,), (7,)], "id long")).collect()}
    want = {}
    for s in (0, 7):
        queue, done = [(0.0, s)], {}
        while queue:
            dist, v = heapq.heappop(queue)
            if v not in done:
                done[v] = dist
                for (a, b), w in arcs.items():
                    if a == v:
                        heapq.heappush(queue, (dist + w, b))
        want |= {(s, v): x for v, x in done.items()}
    assert got == want


def test_default_vertices(spark):
    v = spark.createDataFrame([(3, "a"), (7, "b"), (5, "c"), (2, "d")], "id long, name string")
    out = graph.with_default_vertices(v, edges(spark, [(3, 7), (5, 3), (2, 5), (5, 7), (4, 0)]), {"name": "none"})
    assert {r.id: r.name for r in out.collect()} == {3: "a", 7: "b", 5: "c", 2: "d", 4: "none", 0: "none"}


def test_ledger_matches_plain_loop(spark):
    rng = random.Random(9)
    ops = [(k, rng.randrange(1000), rng.randrange(5), rng.choice([-1, 1]) * rng.randint(1, 400), "x") for k in range(400)]
    df = spark.createDataFrame(ops, "tx_id long, ms long, account long, delta_cents long, kind string")
    got = {r.tx_id: (r.status, r.balance_cents) for r in ledger.settle(df, 500).collect()}
    held = {}
    for k, _, a, d, _ in sorted(ops, key=lambda o: (o[2], o[1], o[0])):
        b = held.get(a, 500)
        ok = d >= 0 or -d <= b
        held[a] = b + d if ok else b
        assert got[k] == ("SETTLED" if ok else "REJECTED", held[a])


def test_sources(spark, tmp_path):
    (tmp_path / "run-3.txt").write_text("# c\n1 2\n2 2\nx y\n3 1\n5\n")
    assert sorted(map(tuple, files.read_edge_list(spark, str(tmp_path)).collect())) == [(1, 2), (3, 1)]
    assert {r.rep for r in files.read_logs(spark, str(tmp_path)).collect()} == {3}
    feed = spark.createDataFrame([('data: {"a": 1}',), ("data: {bad",), ("event: x",)], "value string")
    assert [r.a for r in files.parse_sse(feed, "a int").collect()] == [1]
    assert R.drop_sensitive(feed, "value").columns == ["value"]


def test_stream_equals_batch_and_restart_adds_once(spark, tmp_path):
    rows = spark.range(300).select((F.col("id") * 60).cast("timestamp").alias("ts"), (F.col("id") % 3).alias("k"))
    rows.write.parquet(f"{tmp_path}/in")
    job = lambda df: windows.counts(windows.with_event_time(df, "ts", "1 minute"), "ts", ["k"], "10 minutes")
    stream = lambda: spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    for _ in range(2):
        windows.start_parquet(job(stream()), "w", f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
        rows.where("false").union(spark.sql("select timestamp'2030-01-01 00:00:00', 9L")).write.mode("append").parquet(f"{tmp_path}/in")
    got = {(r.start, r.k): r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r.start, r.k): r.n for r in job(rows).collect()}
    assert got == want


def test_upsert_is_idempotent(spark, tmp_path):
    put = windows.upsert_latest(str(tmp_path / "t"), ["k"], "o")
    a = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, o int, v string")
    b = spark.createDataFrame([(1, 2, "c"), (2, 0, "d")], "k int, o int, v string")
    for n, batch in ((0, a), (1, b), (1, b)):
        put(batch, n)
    assert {r.k: r.v for r in windows.snapshot(spark, str(tmp_path / "t")).collect()} == {1: "c", 2: "b"}


def test_cycles_of_three_match_plain_loop(spark):
    """A busy account, ties in time, repeated pairs and loops."""
    rng = random.Random(11)
    rows = [(k, *((0, rng.randrange(1, 9)) if k % 3 == 0 else (rng.randrange(1, 9), 0) if k % 3 == 1 else (rng.randrange(9), rng.randrange(9))), rng.randrange(40) * 50, rng.randint(1, 100)) for k in range(150)]
    tx = spark.createDataFrame(rows, "tx_id long, orig long, dest long, ms long, amount_cents long")
    got = ledger.cycles3(tx, 300, 120).select("tx1", "tx2", "tx3", "a", "b", "c", "total").collect()
    want = []
    for t3, a, b, ms, m in rows:
        early = [r for r in rows if ms - 300 <= r[3] <= ms and r[1] != r[2]]
        for t1, o1, c, _, m1 in early:
            if a != b and o1 == b and c not in (a, b):
                want += [(t1, r[0], t3, a, b, c, m + m1 + r[4]) for r in early if r[1] == c and r[2] == a and m + m1 + r[4] >= 120]
    assert sorted(map(tuple, got)) == sorted(want) != []
    assert ledger.cycles3(tx.limit(0), 300, 120).count() == 0


@pytest.mark.parametrize("paired_up_to", [0, 2, 64])
def test_by_tags_matches_plain_loop(spark, paired_up_to):
    """Repeated ratings and tag rows, null scores, users who have seen all."""
    rng = random.Random(12)
    ratings = [(u, rng.randrange(12), float(rng.randint(1, 5))) for u in range(6) for _ in range(9)] + [(7, i, 5.0) for i in range(12)]
    tags = [(rng.randrange(12), f"t{rng.randrange(5)}", rng.choice([None, 0.25, 0.5, 0.75, 1.0])) for _ in range(60)]
    got = recommend.by_tags(spark.createDataFrame(ratings, "user long, item long, rating double"), spark.createDataFrame(tags, "item long, tag string, score double"), 3, 3, paired_up_to=paired_up_to)
    strong = [t for t in tags if t[2] is not None and t[2] >= 0.5]
    want = []
    for u in sorted({r[0] for r in ratings}):
        by_tag, by_item = {}, {}
        for _, item, _ in (r for r in ratings if r[0] == u and r[2] >= 4):
            for _, tag, score in (t for t in strong if t[0] == item):
                by_tag.setdefault(tag, []).append(score)
        best = sorted(by_tag, key=lambda t: (-round(sum(by_tag[t]) / len(by_tag[t]), 9), t))[:3]
        for item, tag, score in strong:
            if tag in best and item not in {r[1] for r in ratings if r[0] == u}:
                by_item.setdefault(item, []).append((tag, score))
        scored = [(u, i, len({t for t, _ in x}), round(sum(s for _, s in x) / len(x), 9)) for i, x in by_item.items()]
        want += [(*r, k + 1) for k, r in enumerate(sorted(scored, key=lambda r: (-r[2], -r[3], r[1]))[:3])]
    assert sorted(map(tuple, got.select("user", "item", "matched_tags", "avg_tag_score", "rank").collect())) == sorted(want) != []

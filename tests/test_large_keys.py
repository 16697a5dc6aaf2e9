"""Keys that hold a large share of all rows: ledgers in blocks, order statistics without a group in one task, many sources of paths."""

import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowyard.operators import graph, ledger, selection
from sparrowyard.operators import relational as R

OPS = "tx_id long, ms long, account long, delta_cents long, kind string"


def loop(ops, opening):
    out, balance, seq = [], {}, {}
    for tx, ms, account, delta, kind in sorted(ops, key=lambda r: (r[1], r[0], r[4], r[3])):
        b = balance.get(account, opening)
        ok = delta >= 0 or -delta <= b
        balance[account] = b + (delta if ok else 0)
        seq[account] = seq.get(account, 0) + 1
        out.append((tx, ms, account, delta, kind, "SETTLED" if ok else "REJECTED", balance[account], seq[account]))
    return sorted(map(str, out))


@pytest.mark.parametrize(("opening", "lean"), [(500, 0), (50_000, 0), (0, -60), (300, 60)])
def test_blocks_of_an_account_equal_the_plain_loop(spark, opening, lean):
    rng = random.Random(opening + lean)
    ops = [(k, rng.randrange(3000), rng.choice([1, 1, 1, 2, 3, None, 2**60 + 1]), rng.randint(-200, 200) + lean, rng.choice(["debit", "credit"])) for k in range(3000)]
    ops += ops[:20]  # repeated rows
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        got = ledger.settle(spark.createDataFrame(ops, OPS).repartition(5), opening)
        assert sorted(str(tuple(r)) for r in got.select("tx_id", "ms", "account", "delta_cents", "kind", "status", "balance_cents", "apply_seq").collect()) == loop(ops, opening)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert ledger.settle(spark.createDataFrame([], OPS)).count() == 0


@pytest.mark.parametrize("ordered", [40, 10**6])
def test_order_statistics_equal_sorting(spark, ordered):
    rng = np.random.default_rng(4)
    groups = {"hot": rng.exponential(100, 8000) ** 3, "same": np.full(500, 7.0), "few": np.array([3.0]), None: np.concatenate([rng.integers(0, 5, 900).astype(float), [1e300, -1e300]])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("hot", None), ("void", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    ps = [0.0, 0.5, 0.95, 0.99, 1.0]
    got = {r.g: r for r in R.nearest_rank(df, ["g"], "v", ps, ordered).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert [got[g][f"p{round(p * 100)}"] for p in ps] == [sorted(vs)[round(p * (len(vs) - 1))] for p in ps]
    lines = {r.g: r for r in R.percentiles(df.where("v is not null"), ["g"], "v", ps, ordered).collect()}
    for g, vs in groups.items():
        assert np.allclose([lines[g][f"p{round(p * 100)}"] for p in ps], np.quantile(vs, ps), rtol=1e-9)
    assert R.nearest_rank(df.limit(0), ["g"], "v", ps, ordered).count() == 0


def test_a_range_of_one_key_gets_small_without_moving_its_values(spark):
    df = spark.range(300_000).select(F.lit(1).alias("k"), (F.col("id") * 7919 % 300_007).cast("double").alias("v")).repartition(8)
    found = selection.order_statistics(df, ["k"], "v", {"median": lambda n: (n / 2).cast("long")}, ordered=5000)
    assert found.first().median == float(np.sort(np.arange(300_000) * 7919 % 300_007)[150_000])


def test_paths_from_many_sources(spark, monkeypatch):
    monkeypatch.setattr(graph, "TOGETHER", 7)
    rng = random.Random(8)
    arcs = {(rng.randrange(60), rng.randrange(60)): float(rng.randint(0, 9)) for _ in range(170)}
    sources = list(range(0, 60, 3)) + [777]
    e = spark.createDataFrame([(a, b, w) for (a, b), w in arcs.items()], "src long, dst long, w double")
    got = {(r.source, r.node): r.dist for r in graph.shortest_paths(e, spark.createDataFrame([(s,) for s in sources], "id long")).collect()}
    want = {}
    for s in sources:
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
    assert graph.shortest_paths(e, spark.createDataFrame([], "id long")).count() == 0
    with pytest.raises(graph.NotConverged):
        graph.shortest_paths(spark.createDataFrame([(k, k + 1, 1.0) for k in range(40)], "src long, dst long, w double"), spark.createDataFrame([(0,)], "id long"), max_iter=2)


def votes_by_hand(pairs, rounds):
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    labels, seen = {v: v for v in near}, []
    for k in range(1, rounds + 1):
        counts = {v: {} for v in near}
        for v in near:
            for u in near[v]:
                counts[v][labels[u]] = counts[v].get(labels[u], 0) + 1
        new = {v: min(c, key=lambda x: (-c[x], x)) for v, c in counts.items()}
        if new == labels:
            return new, k, True
        labels = new
        if labels in seen:
            return labels, k, False
        seen.append(labels)
    return labels, rounds, False


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_labels_to_the_end_or_to_and_fro(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(60)] if seed < 3 else [(0, 1), (2, 3), (4, 5), (5, 6), (6, 4)]
    e = graph.clean_edges(spark.createDataFrame(pairs, "src long, dst long"), directed=False)
    labels, rounds, done = graph.label_propagation(e, 50)
    assert ({r.id: r.label for r in labels.collect()}, rounds, done) == votes_by_hand(pairs, 50)
    if seed == 3:
        assert not done and rounds < 50  # pairs swap their labels for ever


def test_communities_list_their_members(spark):
    labels = spark.createDataFrame([(1, 100), (2, 100), (5, 200), (4, 200), (3, 200)], "id long, label long")
    assert [(r["rank"], r.label, r["size"], r.members) for r in graph.communities(labels, members=True).orderBy("rank").collect()] == [(1, 200, 3, [3, 4, 5]), (2, 100, 2, [1, 2])]
    assert {r.members for r in graph.communities(labels, members=True, limit=4).collect()} == {None} and "members" not in graph.communities(labels).columns

"""Cycles in cells: equal to brute force for any cut into cells, with no path or hit shuffled."""

import random

import pytest

from sparrowyard.operators import alerts, cycles, ledger

TX = "tx_id long, orig long, dest long, ms long, amount_cents long"


def made(seed, n, accounts, until):
    rng = random.Random(seed)
    return [(i, rng.randrange(accounts), rng.randrange(accounts), rng.randrange(until), rng.randrange(1, 50)) for i in range(n)]


@pytest.fixture
def unicast(spark):
    """Joins shuffle, as they do on large tables."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def shuffled_rows(spark, run):
    """What ``run`` returns, and the rows that it shuffled."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    return run(), written() - before


def by_hand(rows, hops, span, least):
    out = []

    def grow(walk):
        last = walk[0]
        for x in rows:
            if x[1] == walk[-1][2] and last[3] - span <= x[3] <= last[3]:
                if len(walk) == hops - 1:
                    if x[2] == last[1] and sum(t[4] for t in [*walk, x]) >= least:
                        out.append((*[t[0] for t in walk[1:]], x[0], last[0]))
                elif x[2] not in [t[1] for t in walk] and x[2] != x[1]:
                    grow([*walk, x])

    for r in rows:
        if r[1] != r[2]:
            grow([r])
    return sorted(out)


@pytest.mark.parametrize("hops, cell", [(3, 12), (4, 40), (3, 1000)])
def test_any_cut_into_cells_gives_all_cycles(spark, hops, cell):
    rows = [*made(5, 60, 6, 3000), *[(100 + i, 1, 2, 500 + i, 20) for i in range(30)]]  # a busy pair, cut into parts
    got = cycles.found(spark.createDataFrame(rows, TX).repartition(3), hops, 900, 60, cell)
    ids = sorted(tuple(r[f"tx{i}"] for i in [*range(1, hops), 0]) for r in got.collect())
    assert ids == by_hand(rows, hops, 900, 60) and ids


def test_pieces_cover_ranges():
    import numpy as np

    begin, end = np.array([5, 0, 7, 2]), np.array([9, 0, 8, 12])
    got = [(o, p) for of, at in cycles.pieces(begin, end, 3) for o, p in zip(of.tolist(), at.tolist(), strict=True)]
    assert got == [(i, p) for i, (b, e) in enumerate(zip(begin, end, strict=True)) for p in range(b, e)]


def test_cycles_of_three_shuffle_transfers_and_not_pairs(spark, unicast):
    tx = spark.createDataFrame([(i, i % 5, (i // 5 + i % 5 + 1) % 5, 10 * i, 30) for i in range(1500)], TX)
    n, rows = shuffled_rows(unicast, lambda: ledger.cycles3(tx, 3000, 50).count())
    assert n > 100_000 and rows < 20_000


def test_cycles_of_four_shuffle_transfers_and_not_paths(spark, unicast):
    tx = spark.createDataFrame([(i, i % 5, (i // 5 + i % 5 + 1) % 5, 10 * i, 30) for i in range(600)], TX)
    n, rows = shuffled_rows(unicast, lambda: ledger.temporal_cycles(tx, 4, 1500, 50).count())
    assert n > 100_000 and rows < 20_000


@pytest.mark.parametrize("cell", [12, 60, 100_000])
def test_first_cycles_of_a_minute_are_those_of_all_hits(spark, cell):
    rows = [(i, u, v, ms * 60, amount) for i, u, v, ms, amount in made(7, 250, 5, 9000)] + [(300 + i, 1, 2, 100_000 + 400 * i, 3 + i % 20) for i in range(40)]
    rows += [(i, 4, 3, 100_000 + i, 40) for i in range(300, 306)]  # ids that other accounts have too
    tx = spark.createDataFrame(rows, TX)
    wanted = alerts.first_of_minute(alerts.cycle_hits(tx, 100_000, 70))
    got = alerts.cycle_alerts(tx.repartition(3), 100_000, 70, cell)
    want = sorted(map(tuple, wanted.collect()))
    assert len(want) > 200 and sorted(map(tuple, got.select(*wanted.columns).collect())) == want


def test_alerts_do_not_shuffle_hits(spark, unicast):
    tx = spark.createDataFrame([(i, i % 5, (i // 5 + i % 5 + 1) % 5, 10 * i, 30, "TRANSFER") for i in range(1500)], f"{TX}, type string")
    n, rows = shuffled_rows(unicast, lambda: alerts.alerts(tx, cycle=(3000, 50)).count())
    assert n == 20 + 60 + 5 + 5 and rows < 60_000  # of two hops, of three, bursts

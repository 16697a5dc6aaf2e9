"""Near-duplicates by shingle similarity against brute force."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparrowyard.llm import simhash, similar

SCHEMA = "doc_id long, text string"


def text_of(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def sets_of(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def components_of(rows):
    """Brute force: the groups of row numbers that pairs at 0.8 and above connect."""
    sets, least = [sets_of(t) for _, t in rows], list(range(len(rows)))
    for a, b in combinations(range(len(rows)), 2):
        if jaccard(sets[a], sets[b]) >= 0.8:
            x, y = sorted((least[a], least[b]))
            least = [x if r == y else r for r in least]
    return least


def planted(rng, n=100):
    """Pairs of a text and a copy whose changed stretch leaves similarities between about 0.75 and 0.97."""
    rows = []
    for i in range(n):
        a = text_of(rng, rng.randint(60, 300))
        changed = max(1, int(len(a) * (0.01 + 0.12 * i / n)) - 4)
        at = rng.randrange(len(a) - changed)
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(a[:at] + text_of(rng, changed) + a[at + changed :]))]
    return rows


def test_pairs_from_080_up_are_found(spark):
    rows = planted(random.Random(3))
    near = [i for i in range(0, len(rows), 2) if jaccard(sets_of(rows[i][1]), sets_of(rows[i + 1][1])) >= 0.8]
    assert 60 < len(near) < 100
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA).repartition(4), "")
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {i + 1 for i in near}


@pytest.mark.parametrize("limit", [2, 16])
def test_large_group_stays_whole(spark, limit):
    rng = random.Random(4)
    base = text_of(rng, 300)
    rows = [(i, " ".join(base[:j] + ["new", str(i)] + base[j:])) for i, j in enumerate(rng.sample(range(300), 150))]
    rows += [(1000 + i, " ".join(text_of(rng, 100))) for i in range(20)]
    assert len({*components_of(rows)}) == 21
    out = similar.near_duplicates(spark.createDataFrame(rows, SCHEMA), all_pairs=limit)
    assert out.select("root").distinct().count() == 21 and out.count() == len(rows)


def test_blank_and_short_texts(spark):
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "One  two"), (5, "one three"), (6, "a b c d e f")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("x", F.lit(1))
    kept = similar.deduplicated(df)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 5, 6] and kept.columns == df.columns
    assert similar.deduplicated(df.limit(0)).count() == 0


@pytest.mark.parametrize("module", [similar, simhash])
def test_null_and_repeated_ids_lose_no_other_text(spark, module):
    rng = random.Random(6)
    a, b, c, d = (" ".join(text_of(rng, 80)) for _ in range(4))
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (8, d), (7, c), (None, c)]
    kept = module.deduplicated(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(0, a), (0, b), (7, c), (7, d)])


@pytest.mark.parametrize("wider", [similar.WIDER, ()])
def test_texts_around_a_common_passage_are_compared_whatever_their_number(spark, wider):
    """Texts of a common passage lie below 0.8 of each other, some pairs above it: large mixed cells, all links found."""
    rng = random.Random(11)
    passage = text_of(rng, 220)
    rows = []
    for i in range(60):
        own = text_of(rng, 45)
        rows.append((2 * i, " ".join(passage + own)))
        if i % 3 == 0:
            rows.append((2 * i + 1, " ".join(passage + own[: rng.randint(25, 40)] + text_of(rng, 12))))
    want = {}
    for (i, _), root in zip(rows, components_of(rows), strict=True):
        want.setdefault(root, set()).add(i)
    assert 30 < len(want) < len(rows)
    got = {}
    for r in similar.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), all_pairs=4, wider=wider).collect():
        got.setdefault(r.root, set()).add(r.id)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_near_fingerprints_are_linked_by_the_pivot_tables_and_verified(spark, monkeypatch):
    """Without any band, texts whose fingerprints differ by 4 bits or fewer still meet, and only those at 0.8 are linked."""
    rng = random.Random(21)
    rows = []
    for i in range(0, 60, 2):
        a = text_of(rng, 400)
        rows += [(i, " ".join(a)), (i + 1, " ".join(a[:i] + ["new"] + a[i:]))]
    rows += [(1000, "one two three"), (1001, "one two three four")]
    prints = {i: similar._fingerprint(similar.shingles(t)) & (1 << 64) - 1 for i, t in rows}
    near = {i for i in range(0, 60, 2) if (prints[i] ^ prints[i + 1]).bit_count() <= 4}
    assert len(near) > 20 and len(components_of(rows)) - len({*components_of(rows)}) == 30
    monkeypatch.setattr(similar, "_pairs", lambda cells, *_: cells.sparkSession.createDataFrame([], "u long, v long"))
    found = similar.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3))
    groups = {}
    for r in found.collect():
        groups.setdefault(r.root, []).append(r.id)
    assert sorted(sorted(g) for g in groups.values() if len(g) > 1) == [[i, i + 1] for i in sorted(near)]


def test_mixed_cells_are_found_without_a_row_for_each_pair_or_join(spark):
    """Texts of cells over the limit that several components share; their rows come from one pass over the cells."""
    rng = random.Random(5)
    rows = [(cell, c, c if cell % 3 else 7) for cell in range(40) for c in rng.sample(range(500), rng.randint(1, 30))]
    found = similar._mixed(spark.createDataFrame(rows, "cell long, c long, root long"), 16)
    of = lambda cell: [r for r in rows if r[0] == cell]
    want = [(*r, len(of(r[0]))) for r in rows if len(of(r[0])) > 16 and len({x[2] for x in of(r[0])}) > 1]
    assert want and sorted(map(tuple, found.select("cell", "c", "root", "n").collect())) == sorted(want)
    assert "Join" not in found._jdf.queryExecution().toString()


def test_long_signatures_leave_out_pairs_below_the_similarity(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    common = rng.integers(0, 2**64, 400, np.uint64)
    at = lambda shared: np.unique(np.concatenate([common[:shared], rng.integers(0, 2**64, 400 - shared, np.uint64)]))
    sets = [at(330) for _ in range(60)]  # of these, two are alike by 0.70
    sets += [np.unique(np.concatenate([s[:370], rng.integers(0, 2**64, 30, np.uint64)])) for s in sets[:20]]  # and each with its own by 0.86
    rows = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "c long, s binary")
    pairs = {}
    for how in ((130, 12), (*similar.LONG_OF, similar.LONG)):
        cells = similar._banded(rows, *how).selectExpr("0L as cell", "0L as o", "*", "c as root")
        pairs[how[0]] = {(r.u, r.v) for r in similar._pairs(cells, 64, 4 * similar.BLOCK, 0.8).collect()}
    assert {(i, 60 + i) for i in range(20)} <= pairs[128]
    assert len(pairs[128]) < 200 and len(pairs[130]) > 1000

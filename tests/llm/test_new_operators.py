"""Merkle proofs, context mixing and periodic runs against brute force, and mixes whose sources stop at their cap."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparrowyard.llm import context_mixing, merkle, mixing, periodic, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, tree int, slice string, pos int"
SPACES = re.compile(rb"[\x20\x09-\x0D]+")


def words_of(text):
    return [w for w in SPACES.split((text or "").encode()) if w]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    prose = lambda n: " ".join(f"w{min(int(rng.paretovariate(0.6)), 400)}" for _ in range(n))
    texts = [None, "", " \n", "one", "Aé aé AÉ\x0bx", "a " * 40, "to be or not " * 9 + "end", prose(3000), "x" * 50_000, "ab ba " * 30 + prose(20) + " ab ba" * 30, *[prose(rng.randint(1, 160)) for _ in range(50)]]
    out = [(i, t, ["en", "de", None, "é", "en"][i % 5], [None, "a", ""][i % 3], None if i % 11 == 3 else len(t or ""), "r", 3, "s", 4) for i, t in enumerate(texts)]
    out += [out[7], out[7], (None, "null id", "en", "a", 7, "r", 3, "s", 4), (None, None, "only", None, None, "r", 3, "s", 4), (20, "same id " * 8, "en", None, 1, "r", 3, "s", 4)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def folder(docs, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("docs"))
    docs.write.parquet(f"{at}/documents.parquet")
    return at


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def proofs_of(rows):
    """Every row's leaf, subroot, root, hash of siblings and folded root."""

    def leaf(r, more=0):
        n = None if r[4] is None else r[4] + more
        return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], n, r[1])])

    def climbed(level):
        passed, at = [[] for _ in level], list(range(len(level)))
        while len(level) > 1:
            for i, a in enumerate(at):
                b = a ^ 1
                passed[i].append((b < a, level[b]) if b < len(level) else None)
                at[i] = a // 2
            level = [sha(*level[k : k + 2]) for k in range(0, len(level), 2)]
        return level[0], passed

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    below = []
    for g in order:
        members = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        below.append((members, *climbed([leaf(r) for r in members])))
    root, above = climbed([x[1] for x in below])
    out = []
    for (members, subroot, passed), up in zip(below, above, strict=True):
        for r, way in zip(members, passed, strict=True):
            h = leaf(r, 1 if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else 0)
            for s in [*way, *up]:
                h = sha(h) if s is None else sha(s[1], h) if s[0] else sha(h, s[1])
            out.append((str(r[0]), leaf(r), subroot, root, sha(*[s[1] for s in [*way, *up] if s]), h, h == root))
    return sorted(out)


@pytest.mark.parametrize(("span", "broadcast"), [(9, 100_000), (2, 100_000), (2, 0)])
def test_merkle_proofs(spark, rows, folder, monkeypatch, span, broadcast):
    monkeypatch.setattr(merkle, "SPAN", span)
    monkeypatch.setattr(merkle, "BROADCAST", broadcast)
    got = sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in queries.op11_merkle_proofs(spark, folder).collect())
    assert got == proofs_of(rows)
    assert 0 < sum(not r[-1] for r in got) < len(got)


def test_empty_tables(spark, docs, tmp_path):
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for q in (queries.op11_merkle_proofs, queries.op12_context_mixing, queries.op13_periodic_runs):
        assert q(spark, str(tmp_path)).count() == 0


def runs_by_hand(words, least):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i >= q and j + q - i >= least:
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, t - s, q) for (s, t), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    rng = random.Random(4)
    for k in range(1500):
        words = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randrange(50))]
        if k % 2:
            unit = [rng.randrange(4) for _ in range(rng.randint(1, 9))]
            words = words[:9] + unit * rng.randint(2, 6) + words[9:15] + unit * 2
        least = rng.choice([2, 5, 12])
        assert periodic.runs_of(words, least) == runs_by_hand(words, least)


def test_longest_texts_take_near_linear_time():
    rng = random.Random(6)
    unit = [rng.randrange(10**6) for _ in range(5000)]
    assert periodic.runs_of(unit * 8 + unit[:17]) == [(0, 40_017, 5000)]
    assert periodic.runs_of([1] * 60_000) == [(0, 60_000, 1)]


def test_periodic_runs(spark, docs, rows, folder):
    want = []
    for i, text, *_ in rows:
        w = words_of(text)
        n, h = len(w), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = runs_by_hand(w, 12)
        gone = {k for s, length, p in runs for k in range(s + p, s + length)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((str(i), len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{m},{p}\n" for s, m, p in runs)), hashlib.sha256(kept).hexdigest()))
    got = [(str(r.doc_id), r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in queries.op13_periodic_runs(spark, folder).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(w[1] for w in want) > 5
    whole = periodic.periodic_runs(docs)
    assert whole.select("row.*").columns == docs.columns and whole.count() == len(rows)


def test_context_mixing(spark, docs, rows, folder):
    tokens = [[*SPACES.sub(b" ", (t or "").encode().lower()).split(), None] for _, t, *_ in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, *_ in rows]
    count = Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    total = sum(count.values())
    base = lambda t: sum(math.log10((count[w] + 0.1) / (total + 0.1 * (len(count) + 1))) for w in t)
    want = sorted((str(r[0]), h, len(t), sum(count[w] > 0 for w in t), total, round(base(t), 6)) for r, h, t in zip(rows, held, tokens, strict=True))
    got = queries.op12_context_mixing(spark, folder).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got) and all((r.bits_per_byte is None) == (r.doc_id in (None, 0, 1) and r.n_tokens == 1) for r in got)
    # neither slices nor partitions change a score
    other = context_mixing.scores(docs.repartition(2), slice_bytes=9000)
    assert other.select("row.*").columns == docs.columns
    assert np.allclose(sorted(r.score for r in got), sorted(r.score for r in other.collect()), atol=1e-4)


def test_mixing_predicts_held_out_texts_better_than_counts(spark):
    rng = random.Random(2)
    follow = {k: [rng.randrange(300) for _ in range(3)] for k in range(300)}

    def text():
        at, out = rng.randrange(300), []
        for _ in range(150):
            out.append(f"w{at}")
            at = rng.choice(follow[at]) if rng.random() < 0.9 else rng.randrange(300)
        return " ".join(out)

    df = spark.createDataFrame([(i, text()) for i in range(400)], "doc_id long, text string")
    held = context_mixing.scores(df).where("held_out").agg(F.sum("base_score"), F.sum("score"), F.sum("n_tokens")).first()
    bits = [-x * math.log2(10) / held[2] for x in held[:2]]
    assert bits[0] > 7.5 and bits[1] < 4.5  # some 2.6 bits a word are chance


def test_both_branches_of_a_decision_add_up_to_one():
    n = np.repeat(np.arange(200), 200)
    b = np.minimum(np.tile(np.arange(200), 200), n)
    assert np.array_equal(context_mixing.log_odds(n, b), -context_mixing.log_odds(n, n - b))
    # a slice of two texts: every input of a decision is turned around where the other branch is taken
    hashes = np.array([1, 2, 3], np.uint64) << np.uint64(64 - context_mixing.BITS)
    tokens = context_mixing.Tokens(hashes, np.array([0, 1, 0, 2, 0, 1], np.int32), np.array([0, 6]))
    predicted, cls = tokens.matched()
    assert cls.tolist() == [0, 0, 0, 1, 0, 1] and predicted[[3, 5]].tolist() == [2, 3]


@pytest.mark.parametrize("case", ["one", "several", "all", "near"])
def test_sources_at_their_cap(spark, case):
    rng = random.Random(case)
    doc = lambda n: " ".join(["w"] * n)
    small = {"one": [None], "several": ["a", "c", None], "all": [], "near": ["b"]}[case]
    rows = [(i, s, doc(rng.randint(1, 900) if s not in small else rng.randint(1, 4))) for i, s in enumerate(rng.choice(["a", "b", "c", "d", None]) for _ in range(150))]
    if case == "near":  # a target just below three times the size, in two classes
        rows = [(0, "b", doc(60)), (1, "b", doc(300)), *[(2 + k, "a", doc(rng.randint(20, 60))) for k in range(20)]]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    assert len(out) == len(rows) and all(0 <= r.copies <= 3 for r in out)
    for s in {r.src for r in out}:
        of = [r for r in out if r.src == s]
        taken, longest = sum(r.taken for r in of), max(r.size for r in of)
        assert abs(taken - of[0].target) <= longest
        if of[0].target >= 3 * of[0].source_size:
            assert all(r.copies == 3 for r in of)


def test_weights_learn_from_every_training_text(spark):
    """A text's order of words changes only its own counts and the starting weights, so the others' scores tell whether it was learned from."""
    rng = random.Random(7)
    rows = [(i, " ".join(f"w{rng.randrange(200)}" for _ in range(20))) for i in range(900) if zlib.crc32(str(i).encode()) % 10]
    own = [f"x{k % 40}" for k in range(1000)]

    def outside():  # an order that a sample of 400 texts by hash would not have
        while True:
            t = " ".join(["first", *own, "last"])  # what other texts share with it, the ends of texts, stays
            if spark.range(1).select(F.pmod(F.xxhash64(F.lit(t)), F.lit(1 << 30))).first()[0] > int(400 / len(rows) * (1 << 30)):
                return t
            rng.shuffle(own)

    def scored():
        df = spark.createDataFrame([*rows, (1000, outside())], "doc_id long, text string").repartition(3)
        return {r.row.doc_id: r.score for r in context_mixing.scores(df).collect()}

    before = scored()
    rng.shuffle(own)
    after = scored()
    assert max(abs(before[i] - after[i]) for i, _ in rows) > 1e-3


def test_tally_is_of_all_decisions_and_without_the_own_occurrence():
    texts = pa.array(["a b a b c", "a b d", None])
    tokens = context_mixing.Tokens.of(texts)
    cells = np.bincount(tokens.codes[tokens.index] >> 4, minlength=1 << 16)
    got = []
    for kind, keys, count in context_mixing._keys(tokens, np.ones(3, bool), (0, 1, 2)):
        path = context_mixing._along(keys, count, context_mixing._levels(kind))
        exact = [path[-1]] if kind else [count, path[-1] - count, np.zeros(len(keys), np.int64)]
        got.append((kind, 0, [context_mixing._press_counts(x) for x in (context_mixing._untaken(keys, path, context_mixing._levels(kind)), *exact)]))
    p = context_mixing.Predictors.of_slice(tokens, got, cells, 1)
    tally = context_mixing.tallied(p, np.array([True, False, True]))
    assert tally.sum() == context_mixing.BITS * (6 + 1)
    pairs, number = tokens.pairs()
    once = np.bincount(number) == 1
    assert 0 < once.sum() < len(pairs) and (p.seen[once, -1] // (context_mixing.MATCHES * context_mixing.DEPTHS) == 0).all()
    w = context_mixing.fitted(tally.sum(axis=0))
    assert w.shape == (3,) and np.isfinite(w).all()

"""The ten operators against brute force, on texts with nulls, blanks, ties, copies, long words and clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparrowyard.llm import mixing, neighbours, pii, quality, queries, sentencepieces, sharding, simhash, substrings, token_files, transcripts
from sparrowyard.llm.common import scratch_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, q int"


def prose(rng, n):
    return " ".join("".join(rng.choice(["ab", "ko", "ri", "ten", "é", "ul", "Sa"]) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = prose(rng, 400)
    passage = prose(rng, 90)
    texts = [
        None, "", " \n\t ", base, base, base.replace("ko", "Ko", 1), "x" * 5000, "one two three", prose(rng, 60) + "\n" + passage + "\n" + prose(rng, 60),
        passage + " " + prose(rng, 300), "again and " * 200, "mail a.b@c-d.org or +1 (310) 555-4510, card 4111 1111 1111 1111, host 10.0.0.255 and 1.2.3.999", "héllo  wörld <|endoftext|> ▁ x\x0by",
        "call 310-555-4510 now; token = \"ghp_0a1b2c3d4e5f6a7b8c9d0e1f2a3b4c5d6e7f\" end", "1 " * 40 + "+++ @@@ a@b a@b.c_d@e.f 4111111111111111 4111111111111112",
    ] + [prose(rng, rng.randint(55, 200)) for _ in range(20)]
    return [(i, t, "en", [None, "a", "b", "é"][i % 4], len(t or ""), "clash", 1) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return (t or "").encode().split()


def by_id(df, *cols):
    return {r[0]: tuple(r[1:]) for r in df.select("doc_id", *cols).collect()}


def test_simhash_matches_brute_force(docs, rows, empty):
    def fp(t):
        w = (t or "").encode().lower().split()
        if not w:
            return 0
        hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    fps = {r[0]: fp(r[1]) for r in rows}
    least = {i: i for i in fps}
    for _ in fps:
        for a in fps:
            least[a] = min(least[b] for b in fps if bin(fps[a] ^ fps[b]).count("1") <= 4)
    got = by_id(simhash.near_duplicates(docs), "fp", "component_id")
    assert {i: (f & (2**64 - 1), c) for i, (f, c) in got.items()} == {i: (fps[i], least[i]) for i in fps}
    kept = simhash.deduplicated(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({*least.values()}) and kept.columns == docs.columns
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("limit", [3, 20_000])
def test_cells_of_any_size_give_the_same_components(spark, limit):
    from sparrowyard.llm.components import components

    rng = np.random.default_rng(3)
    fps = {int(x) for x in rng.integers(-(2**62), 2**62, 60)}
    seed = fps.copy().pop()
    for _ in range(60):  # a crowd and a chain
        fps.add(seed ^ (1 << int(rng.integers(0, 62))))
        seed ^= int((1 << int(rng.integers(0, 60))) | (1 << int(rng.integers(0, 60)))) if rng.random() < 0.3 else 0
        fps.add(seed)
    found = components(simhash.links_of(spark.createDataFrame([(f,) for f in fps], "fp long"), cell_limit=limit))
    roots = {r.u: r.root for r in found.collect()}
    want = {f: f for f in fps}
    for _ in fps:
        for a in fps:
            want[a] = min(want[b] for b in fps if bin((a ^ b) & (2**64 - 1)).count("1") <= 4)
    assert {f: roots.get(f, f) for f in fps} == want


def test_sentencepiece_equals_library(docs, rows, empty):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.row.doc_id: (list(r.ids), r.decoded) for r in sentencepieces.encode(docs, path).collect()}
    for i, t, *_ in rows:
        ids = sp.encode(t or "", add_eos=True)
        assert got[i] == (ids, sp.decode(ids))
    assert sentencepieces.encode(empty, path).count() == 0


def test_token_files_with_null_and_repeated_ids(spark, tmp_path):
    path, to = queries.tokenizer_path("word_bpe_49k.json"), str(tmp_path / "ids")
    texts = [f"text {i} of the null ones" for i in range(40)]
    rows = [(None, x) for x in texts] + [(7, f"seven {i}") for i in range(40)] + [(i, "plain" if i != 3 else None) for i in range(5)] + [(8, "a " * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    manifest = token_files.write(df, to, path, 2, rows_per_file=10)
    got = sorted(token_files.read(spark, to, manifest).collect(), key=lambda r: r.start)
    t = Tokenizer.from_file(path)
    ids = lambda x: np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
    assert sorted((r.doc_id is not None, r.doc_id or 0, bytes(r.ids)) for r in got) == sorted((i is not None, i or 0, ids(x)) for i, x in rows)
    order = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert order == sorted(order) and [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]
    listed = manifest.orderBy("i").collect()
    assert len(listed) > 6 and max(m.docs for m in listed) < 40 and [m.i for m in listed] == list(range(len(listed)))
    assert [m.before for m in listed] == [sum(x.ids for x in listed[:k]) for k in range(len(listed))]
    with pytest.raises(TypeError):
        token_files.write(df.withColumn("doc_id", F.lit("x")), to, path, 2)


def test_token_files_round_trip(spark, docs, rows, empty):
    path, to = queries.tokenizer_path("word_bpe_49k.json"), scratch_path(spark, "ids")
    manifest = token_files.write(docs, to, path, 2, rows_per_file=7)
    first, n = manifest.orderBy("i").first().path, manifest.count()
    t, start, want = Tokenizer.from_file(path), 0, {}
    for i, text, *_ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want[i] = (start, len(ids), np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert {r[0]: (r[1], r[2], bytes(r[3])) for r in token_files.read(spark, to, manifest).collect()} == want and n > 1
    some = token_files.read_ids(spark, to, first, {0, 3})
    assert {i: x.tobytes() for i, x in some.items()} == {i: want[i][2] for i in (0, 3)}
    with open(first, "r+b") as f:  # the frame's checksum notices a flipped bit
        f.seek(20)
        byte = f.read(1)
        f.seek(20)
        f.write(bytes([byte[0] ^ 1]))
    with pytest.raises(Exception):
        token_files.read_ids(spark, to, first, set(range(8)))
    assert token_files.read(spark, to, token_files.write(empty, to, path, 2)).count() == 0


def test_shards(docs, rows, empty):
    got = sharding.shard_documents(docs, 8).collect()
    for r in got:
        raw = (rows[r.doc_id][1] or "").encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 1, zlib.crc32(raw)) and r.grown_shard in (r.shard, 8)
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard_documents(empty).count() == 0


def test_growth_moves_rows_only_into_the_new_shard(spark):
    ids = spark.range(4000).withColumnRenamed("id", "doc_id")
    for n in (3, 8, 9):
        tree = sharding.tree_of(n)
        df = sharding.assigned(sharding.assigned(ids, "doc_id", tree, "a"), "doc_id", sharding.grow(tree, n), "b")
        moved = df.where("a <> b").groupBy("b").count().collect()
        assert [r.b for r in moved] == [n] and abs(moved[0]["count"] - 4000 / (n + 1)) < 150


def test_quality_figures(docs, rows, empty):
    got = {r.row.doc_id: r.q for r in quality.figures(docs).collect()}
    for i, t, *_ in rows:
        w = [x.decode() for x in words(t)]
        tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        covered = {k + j for k, x in enumerate(tri) if tri.count(x) > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        q = got[i]
        assert (q.n_words, q.word_chars, q.n_repeat_words, q.n_dup_lines) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)))
        assert q.n_symbols == sum(c in "#*$%&|<>" for c in t or "") and q.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (q.base_failed and q.kept)
    assert quality.clean(docs).columns == docs.columns and quality.clean(empty).count() == 0


def test_lines_that_fail(spark):
    cases = {
        "Home | About us | Contact": True, "All rights reserved.": True, "!!! ---": True, "A line of plain prose, with a stop.": False, "": False, "w$$$ " * 12: True, "menu": True,
        "Tous droits réservés, 2024": True, "(Alle Rechte vorbehalten)": True, "Haz clic aquí para ver": True, "Accueil": True, "Über uns": True, "volver arriba": True,
        "unterfolgen sie uns allen": False, "Il est à propos de lui.": False, "Inicio » Ropa » Zapatos": True,
    }
    df = spark.createDataFrame(list(cases.items()), "line string, bad boolean").withColumn("x", F.get(quality.sized(F.array("line")), F.lit(0))).withColumn("about", quality.facts(F.col("line")))
    wrong = df.where(quality.line_fails(F.col("line"), F.col("x.n"), F.col("about")) != F.col("bad")).collect()
    assert not wrong
    prose = "Here is a sentence of plain prose which goes on for a while, and ends.\n" * 6
    rows = [(1, prose + "Alpha\nBeta gamma\nDelta\nLast one\n" + "x"), (2, prose + "Alpha\nBeta gamma\n\nDelta\nLast one"), (3, prose + "Alpha.\nBeta, gamma\nDelta\nLast\none")]
    out = {r.doc_id: r.t for r in quality.figures(spark.createDataFrame(rows, "doc_id long, text string")).select("row.doc_id", F.col("q.cleaned").alias("t")).collect()}
    assert out[1] == prose.rstrip("\n") and [out[i] == t for i, t in rows[1:]] == [True, True]


def test_windows_of_equal_hash_are_told_apart_by_words(spark):
    text = "a b c x a b c y q r s z q r s " * 2
    w = F.split(F.trim("text"), " ")
    df = spark.createDataFrame([(text,)], "text string").select(w.alias("w"))
    by_words = df.select(quality._by_words(F.col("w")).alias("s")).first().s
    t = [tuple(text.split()[i : i + 3]) for i in range(len(text.split()) - 2)]
    assert by_words == [i for i, x in enumerate(t) if t.count(x) > 1]
    # all hashes alike: the packed form must notice it
    packed, same, words, _ = quality._packed_windows(F.col("w"), F.array_repeat(F.lit(5 << 30), len(t)))
    clash = df.withColumn("s", packed).select(F.exists(F.transform("s", lambda x, k: same(x, F.get("s", k - 1)) & ~words(x, F.get("s", k - 1))), lambda x: x).alias("c")).first().c
    assert clash


def test_personal_data(docs, empty, spark):
    import re

    def base(t):
        luhn = lambda d: sum(int(c) if k % 2 == 0 else (2 * int(c) if c < "5" else 2 * int(c) - 9) for k, c in enumerate(reversed(d))) % 10 == 0
        digits = lambda m: re.sub("[^0-9]", "", m)
        rules = [
            ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
            ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
            ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
            ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
        ]
        spans = [(m.start(), k, name, m.end()) for k, (name, p, ok) in enumerate(rules) for m in re.finditer(p, t or "") if ok(m[0])]
        return [f"{n}:{s}:{e}" for s, _, n, e in sorted(spans)]

    found = {r.doc_id: (r.b, r.s) for r in pii.detect(docs).select("row.doc_id", pii.written_spans(F.col("base")).alias("b"), pii.written_spans(F.col("spans")).alias("s")).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i, (b, s) in found.items():
        assert b == ",".join(base(texts[i])) and set(b.split(",")) <= {*s.split(","), ""}
    assert "secret:" in found[13][1]
    clean = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    assert "[EMAIL]" in clean[11] and "4111" not in clean[11] and clean[3] == texts[3] and clean[0] is None
    assert pii.redacted(empty).count() == 0
    many = spark.createDataFrame([(1, "é 10.1.2.3 " * 300)], "doc_id long, text string")
    spans = pii.detect(many).select(pii.written_spans(F.col("base")).alias("b")).first().b.split(",")
    assert spans == [f"ip:{11 * k + 2}:{11 * k + 10}" for k in range(300)]


def test_em_separates_reliable_from_noisy_labelers():
    rng = random.Random(1)
    counts = {}
    for _ in range(4000):
        y = rng.random() < 0.4
        votes = tuple(rng.choice([-1, 0, 1]) if rng.random() < 0.25 else (1 if y else -1) for _ in pii.LABELERS)
        counts[y, votes] = counts.get((y, votes), 0) + 1
    patterns = [("secret", v, n) for (_, v), n in counts.items()]
    post, _, priors = pii.expectation_maximisation(patterns)
    right = sum(n for ((y, _), n), p in zip(counts.items(), post) if (p >= 0.5) == y)
    assert right / 4000 > 0.97 and abs(priors["secret"] - 0.4) < 0.05


def test_repeated_passages(docs, rows, empty):
    first = {}
    for i, t, *_ in rows:
        w = words(t)
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    got = {r.row.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.without_repeats(docs).collect()}
    for i, t, *_ in rows:
        w = words(t)
        gone = {k + j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for j in range(50)}
        assert got[i] == (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
    assert substrings.without_repeats(empty).count() == 0


def test_mix(docs, rows, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for i, t, _, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    goal, open_, left = {}, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, float(sum(sizes.values()))
    while True:
        level = left / sum(open_.values())
        over = [s for s in open_ if level * open_[s] > 3 * sizes[s]]
        if not over:
            goal |= {s: level * w for s, w in open_.items()}
            break
        for s in over:
            goal[s] = 3.0 * sizes[s]
            left -= goal[s]
            del open_[s]
    source = {r[0]: r[3] for r in rows}
    for r in got:
        assert r["size"] == len(words(rows[r.doc_id][1])) and r.taken <= 3 * r["size"] and r.target == pytest.approx(goal[source[r.doc_id]])
    for s in sizes:
        assert sum(r.taken for r in got if source[r.doc_id] == s) == pytest.approx(goal[s], abs=60)
    assert {(r.doc_id, r.taken) for r in got} == {(r.doc_id, r.taken) for r in mixing.mix(docs.repartition(2)).collect()}
    assert mixing.mixed_documents(docs).count() == sum(r.copies for r in got) and mixing.mix(empty).count() == 0


def test_coupled_newton_meets_the_conditions_of_the_optimum(spark):
    rng = random.Random(11)
    sizes = [rng.randint(1, 4000) if rng.random() < 0.5 else rng.randint(1, 100) for _ in range(90)]
    data = [("ab"[rng.random() < 0.3] if n > 300 else "abc"[rng.randrange(3)], i, n, 0.2 + rng.random()) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(data, "src string, id long, size long, base double").withColumn("cls", mixing.length_class(F.col("size")))
    rows = [(r.src, r.id, r["size"], r.cls, r.base) for r in df.collect()]
    assert {r[3] for r in rows} >= {0, 1, 2, 5, 6, 7} and all(r[3] == min(7, max(0, int(np.floor(np.log2(r[2] / 32))) + 1)) for r in rows)
    size = {s: sum(r[2] for r in rows if r[0] == s) for s in "abc"}
    goals = {"a": 1.3 * size["a"], "b": 0.4 * size["b"], "c": 2.2 * size["c"]}
    table = spark.createDataFrame([(s, size[s], g) for s, g in goals.items()], "src string, source_size long, target double")
    solved, mu = mixing.balance(df, table, 3.0, 0.05)
    lam = {r.src: r.lam for r in solved.collect()}
    # the problem is convex, so rates of the exponential form that meet all equations are the optimum, by a plain loop
    rate = lambda s, k, base: min(3.0, base * np.exp(lam[s] + mu[k]))
    words, total = sum(sizes), sum(goals.values())
    for s in goals:
        assert sum(n * rate(a, k, base) for a, _, n, k, base in rows if a == s) == pytest.approx(goals[s], rel=1e-7)
    for c in range(mixing.CLASSES):
        share = sum(n for _, _, n, k, _ in rows if k == c) / words
        assert sum(n * rate(a, k, base) for a, _, n, k, base in rows if k == c) / words + 0.05 * mu[c] == pytest.approx(share * total / words, abs=1e-7)
    assert max(map(abs, mu)) > 0.01  # the classes do count
    made = mixing.rounded(df, solved, mu).collect()
    for r in made:
        assert r.rate == pytest.approx(rate(*next(x[:1] + x[3:] for x in rows if x[1] == r.id)), abs=1e-5)
        assert abs(r.copies - r.rate) < 2 and 0 <= r.copies <= 3
    for s in goals:
        assert sum(r.copies * r["size"] for r in made if r.src == s) == pytest.approx(goals[s], abs=400)
    with pytest.raises(mixing.NotSolved):
        mixing.balance(df, table, 3.0, 0.05, rounds=1)


def test_mixed_rows_with_equal_and_null_ids(spark):
    rows = [(None, "a b c", "s")] * 50 + [(None, "x " * 40, "t")] * 30 + [(7, "a b c", "s"), (7, "d e f", "s"), (7, None, None), (8, "long " * 30, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    copies = mixing.mix(df).collect()
    out = mixing.mixed_documents(df).collect()
    for i, s in {(r[0], r[2]) for r in rows}:
        of = lambda r, i=i, s=s: r.doc_id == i and (r.src[1:] if r.src != "2" else None) == s
        assert sum(r.copies for r in copies if of(r)) == sum(r.doc_id == i and r.source == s for r in out)


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 8))
    x[700:900] = x[700]
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(1500, None), (1501, [0.0] * 8), (1502, [float("nan")] * 8), (1503, [None, *[1.0] * 7])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    about: dict = {}
    asked = df.where("vec_id % 20 = 0")
    asked = asked.union(asked)  # a repeated query is asked once
    got = neighbours.search(df, asked, sample_rows=600, leaf_rows=32, chunk=100, block=10, report=about).toPandas()
    assert 0 < about["share"] <= 1 and about["leaves"] > 8
    hit = 0
    for q, g in got.groupby("query_id"):
        s = neighbours.scores(x[[q]], x)[0]
        s[q] = -np.inf
        best = np.lexsort((np.arange(1500), -s))[:20]
        hit += len({*best} & {*g.vec_id})
        assert sorted(g["rank"]) == list(range(1, 21)) and np.array_equal(s[g.vec_id], g.score)
    assert got.query_id.nunique() == 75 and hit / (75 * 20) >= 0.9
    assert neighbours.search(df.limit(0), df.limit(0)).count() == 0


def test_viterbi_is_the_best_of_all_paths():
    from itertools import product

    rng = np.random.default_rng(4)
    norm = lambda x: np.log(x / x.sum(-1, keepdims=True))
    model = transcripts.RoleModel(norm(rng.random(8)), norm(rng.random((8, 8)) ** 3), norm(rng.random((8, transcripts.N_SYMBOLS * 2)) ** 3))
    for n in (1, 2, 4):
        symbols = rng.integers(0, transcripts.N_SYMBOLS * 2, n)
        score = lambda p, symbols=symbols: model.start[p[0]] + model.emit[p[0], symbols[0]] + sum(model.move[a, b] + model.emit[b, x] for a, b, x in zip(p, p[1:], symbols[1:], strict=False))
        best = max(product(range(8), repeat=n), key=score)
        assert score(transcripts.best_path(model, symbols)) == pytest.approx(score(best), abs=1e-9)


def test_transcripts(spark):
    rng = random.Random(2)
    turns = [(c, k, ("user", "assistant")[k % 2], "\n".join(prose(rng, 6) + ("?" if k % 2 == 0 else ".") for _ in range(rng.randint(1, 2)))) for c in range(60) for k in range(rng.randint(2, 8))]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    model = transcripts.fit(df.where("conv_id < 40"))
    held = [(c, k, r, (f"{'Human' if r == 'user' else 'Bot'}: " if rng.random() < 0.6 else "") + t) for c, k, r, t in turns if c >= 40]
    lines = transcripts.lines_of(spark.createDataFrame(held, df.schema)).cache()
    whole = {}  # each conversation held whole
    for r in sorted(lines.collect(), key=lambda r: (r.conv, r.turn, r.tie, r.line)):
        whole.setdefault(r.conv, []).append(r)
    want = {}
    for rows in whole.values():
        for r, s in zip(rows, transcripts.best_path(model, np.array([r.symbol for r in rows])), strict=True):
            want[int(r.conv), r.turn, r.line] = transcripts.ROLES[s // 2]
    for block in (5, 20_000):  # blocks of a few lines or all at once: the same path
        out = transcripts.roles_of(lines, model, block).collect()
        assert {(int(r.conv_id), r.turn, r.part + i): r.role for r in out for i in range(r.n_lines)} == want
    right = sum(want[c, k, 0] == r for c, k, r, _ in held)
    assert right / len(held) > 0.9
    odd = spark.createDataFrame([(None, None, None, None), (1, 0, "system", "Be brief.\nUser: hi?\nAssistant: yo"), (2, None, "user", "a"), (2, None, "user", "a"), (2, 1, "user", "long\n" * 3000)], df.schema)
    out = transcripts.rendered(transcripts.roles_of(transcripts.lines_of(odd), model, 100)).collect()
    assert {r.role for r in out if r.conv_id == "1"} >= {"user", "assistant"} and any(r.conv_id is None for r in out)
    assert sum(r.n_lines for r in out) == 1 + 3 + 2 + 3001 and sum(r.conv_id == "2" and r.turn is None for r in out) == 2
    copies = df.where("conv_id < 3").crossJoin(spark.range(40)).drop("id")
    assert np.isfinite(transcripts.fit(copies).move).all()
    assert transcripts.roles_of(transcripts.lines_of(df.limit(0)), transcripts.fit(df.limit(0))).count() == 0


def test_pipeline_on_a_small_folder(spark, docs, tmp_path):
    import corpus_pipeline

    docs.drop("row", "q").write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    made = out.collect()
    assert made and all(hashlib.sha256(sp.decode(list(r.ids)).encode()).hexdigest() == r.decoded_sha256 for r in made)
    assert not {0, 1, 2, 4, 7, 10} & {r.doc_id for r in made}  # blank, copied, short and repetitive texts are gone

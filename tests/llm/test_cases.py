"""Cases that every operator defines: null and repeated ids, very long texts, clashing columns, empty tables; and recomputed draws and spans."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from sparrowyard.llm import components, mixing, pii, quality, queries, sentencepieces, sharding, simhash, similar, substrings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, src string, i long, id string, cls int, at long, s string"


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(12)
    prose = lambda n: " ".join(f"w{rng.randrange(4000)}" + rng.choice(["", "", ".", ","]) for _ in range(n))
    shared = prose(120)
    texts = [(None, prose(80)), (None, prose(80)), (None, None), (5, prose(70) + " " + shared), (5, shared + " " + prose(70)), (5, ""), (6, prose(150_000)), (7, shared + " " + prose(60)), (7, shared + " " + prose(60)), (8, "x" * 300_000)]
    rows = [(i, t, None, [None, "a", "b"][k % 3], 1, "r", "s", 2, "d", 9, 4, "z") for k, (i, t) in enumerate(texts)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


def test_odd_rows_keep_their_number(odd):
    rows, df = odd
    n = len(rows)
    model = queries.tokenizer_path("piece_bpe_32k.model")
    counts = {
        "1": simhash.near_duplicates(df).count(), "2": sentencepieces.encode(df, model).count(), "3": sharding.shard_documents(df).count(), "5": pii.detect(df).count(),
        "6": substrings.without_repeats(df).count(), "8": quality.figures(df).count(), "10": mixing.mix(df).count(),
    }
    assert counts == dict.fromkeys(counts, n)
    assert [f(df).columns == df.columns for f in (similar.deduplicated, quality.clean, pii.redacted, mixing.mixed_documents)] == [True] * 4
    removed = {r.row.doc_id: 0 for r in substrings.without_repeats(df).select("row").collect()}
    for r in substrings.without_repeats(df).collect():
        removed[r.row.doc_id] += r.n_removed
    assert removed == {None: 0, 5: 0, 6: 0, 7: 240, 8: 0}  # rows of one id do not take each other's words, nor do null ids
    with pytest.raises(TypeError):
        substrings.without_repeats(df.withColumn("doc_id", F.lit("a"))).count()


def test_empty_pipeline(spark, odd, tmp_path):
    import corpus_pipeline

    odd[1].limit(0).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_draws_are_the_documented_ones(spark):
    def pick(key, children, path):
        weight = lambda x: sum(map(weight, x.values())) if isinstance(x, dict) else x
        u = lambda name: (int(hashlib.md5(f"{key}|{path}{name}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        return min(children, key=lambda name: -math.log(u(name)) / weight(children[name]))

    def shard(key, tree):
        region = pick(key, tree, "")
        rack = pick(key, tree[region], f"{region}/")
        return pick(key, tree[region][rack], f"{region}/{rack}/")

    tree = sharding.tree_of(8)
    tree["region0"]["rack1"][3] = 2.5
    keys = spark.range(400).select(F.when(F.col("id") > 0, F.col("id")).alias("doc_id"))
    got = sharding.assigned(sharding.assigned(keys, "doc_id", tree, "a"), "doc_id", sharding.grow(tree, 8), "b").collect()
    name = lambda i: "" if i is None else str(i)
    assert all((r.a, r.b) == (shard(name(r.doc_id), tree), shard(name(r.doc_id), sharding.grow(tree, 8))) for r in got)


def test_wider_spans_are_candidates_and_planted_ones_are_found(spark):
    planted = {
        "iban": "please pay to account DE89370400440532013000 today", "national_id": "his social security number 219-09-9999 is here",
        "phone_local": "call our office at (310) 555-4510 now", "email_text": "contact jane.roe [at] example [dot] org soon", "secret": "api key: sk-9aF3kLm2Qp8Zx7Vt5Rw1Yb6 end",
    }
    decoys = ["see commit 3f2b8c1d9e7a6b5c4d3e2f1a0b9c8d7e6f5a4b3c for this", "isbn 978-12-3456 page 12", "order no 000-00-0000 shipped", "plain words and 2024-01-02 dates"]
    texts = [f"{t} {i}" for t in planted.values() for i in range(12)] + [f"{t} {i}" for t in decoys for i in range(12)] + ["mail a@b.org or 10.1.2.3, +1 310 555 4510"] * 5
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.b, r.s) for r in pii.detect(df).select("row.doc_id", pii.written_spans(F.col("base")).alias("b"), pii.written_spans(F.col("spans")).alias("s")).collect()}
    for i, (kind, text) in enumerate((k, t) for k, t in planted.items() for _ in range(12)):
        assert kind in {x.split(":")[0] for x in found[i][1].split(",")}, text
    plain = pii.WIDE.replace(r"(?:\G|(?<![A-Za-z0-9]))", r"(?<![A-Za-z0-9])")
    for i, text in enumerate(texts):
        base = [tuple(map(int, x.split(":")[1:])) for x in found[i][0].split(",") if x]
        wide = {(m.start(), m.end()) for m in re.finditer(plain, text)}
        for x in found[i][1].split(","):
            if x and x not in found[i][0].split(","):
                s, e = map(int, x.split(":")[1:])
                assert (s, e) in wide and not any(a < e and s < b for a, b in base)
    assert all(found[60 + k][1] == found[60 + k][0] for k in range(24, 48))  # decoys of the last two forms hold nothing


def test_many_matches_in_one_text(spark):
    text = "é " + "10.1.2.3 " * 9000
    spans = pii.detect(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(pii.written_spans(F.col("base")).alias("b")).first().b.split(",")
    assert spans == [f"ip:{9 * k + 2}:{9 * k + 10}" for k in range(9000)]


def test_components_raise_when_unfinished(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)], "u long, v long")
    with pytest.raises(components.NotConverged):
        components.components(links, rounds=2)
    assert components.components(links).select("root").distinct().count() == 1


def test_components_of_more_links(spark):
    """Links come in parts, as the near-duplicate stage finds them; every part is added to what the parts before connect."""
    rng = random.Random(5)
    parts = [[(rng.randrange(400), rng.randrange(400)) for _ in range(90)] for _ in range(4)]
    parts[2] = parts[0][:20] + [(7, 7)]
    up = {i: i for i in range(400)}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    roots = None
    for part in parts:
        for a, b in part:
            x, y = sorted((top(a), top(b)))
            up[y] = x
        links = spark.createDataFrame(part, "u long, v long").repartition(3)
        roots = components.components(components.contracted(links, 90, 16)) if roots is None else components.joined(roots, links, 90)
        got = roots.collect()
        assert len(got) == len({r.u for r in got}) and {r.u: r.root for r in got}.items() <= {i: top(i) for i in up}.items()
        assert {i for i in up if top(i) != i} <= {r.u for r in got}


def test_adding_links_writes_few_tables(spark, monkeypatch):
    names = []
    monkeypatch.setattr(components, "written", lambda df, name, f=components.written: names.append(name) or f(df, name))
    stars = spark.createDataFrame([(i, i % 5) for i in range(5, 200)], "u long, v long").repartition(4)
    roots = components.components(stars)
    components.joined(roots, spark.createDataFrame([(11, 12), (300, 13)], "u long, v long"), 2).collect()
    assert len(names) == 2  # the links of each call; no round where they are stars

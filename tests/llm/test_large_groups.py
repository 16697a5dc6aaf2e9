"""A line that is shorter than the window, in many documents."""

import random

from pyspark.sql import functions as F

from sparrowyard.llm import substrings


def test_frequent_anchors_are_dealt_out_by_path(spark):
    rng = random.Random(8)
    some = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    line, passage = some(40), some(70)
    rows = [(i, " ".join(some(60) + line + some(60) + (passage + some(20) if i % 5 == 0 else []))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    largest = lambda limit: substrings._dealt(docs, substrings._copies(docs, "doc_id", "text"), "doc_id", "text", 50, 16, limit).where("words is not null or path is not null").groupBy("key").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0]
    # an anchor has 35 windows at most each time it occurs
    assert largest(20) <= 20 * 35 < largest(10**9)
    ranges = lambda limit: sorted(map(tuple, substrings.repeated_ranges(docs, group_limit=limit).select("id", "start", "end").collect()))
    covered = lambda found: {(i, w) for i, a, b in found for w in range(a, b)}
    assert covered(ranges(20)) == covered(ranges(10**9)) == {(i, w) for i in range(5, 60, 5) for w in range(160, 230)}


def test_suffix_ranks_are_the_order_of_the_words():
    rng = random.Random(3)
    words = [rng.choice([b"a", b"b", b"ab", b"c"]) for _ in range(400)]
    for depth in (1, 3, 8, 50):
        ranks = substrings.suffix_ranks(words, depth).tolist()
        paths = [tuple(words[i : i + depth]) for i in range(400 - depth + 1)]
        place = {p: i for i, p in enumerate(sorted({*paths}))}
        assert ranks == [place[p] for p in paths]

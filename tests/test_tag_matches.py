"""Matches of users and items by tags: found in cells, of which only the best rows are shuffled."""

import random

import numpy as np
from pyspark.sql import functions as F

from sparrowyard.operators import postings, recommend


def test_matches_of_many_blocks_are_not_shuffled(spark):
    """Several blocks and parts, few matches that fit a piece, items seen in other blocks, ties at the last place."""
    rng = random.Random(4)
    ratings = [(u, rng.randrange(60), float(rng.randint(3, 5))) for u in range(40) for _ in range(8)] + [(99, i, 5.0) for i in range(60)]
    tags = sorted({(rng.randrange(60), f"t{rng.randrange(12)}"): rng.choice([0.5, 0.7, 0.9]) for _ in range(300)}.items())
    got = recommend.by_tags(spark.createDataFrame(ratings, "user long, item long, rating double"), spark.createDataFrame([(*k, s) for k, s in tags], "item long, tag string, score double"), 4, 5, listed=40, asked=7)
    assert "MapInArrow" in (plan := got._jdf.queryExecution().executedPlan().toString())
    assert not any("hashpartitioning(user" in line and "item" in line for line in plan.split("\n"))
    want = []
    for u in sorted({r[0] for r in ratings}):
        mine, found = {}, {}
        for _, item, _ in (r for r in ratings if r[0] == u and r[2] >= 4):
            for (i, tag), s in tags:
                if i == item:
                    mine.setdefault(tag, []).append(s)
        best = sorted(mine, key=lambda t: (-round(sum(mine[t]) / len(mine[t]), 9), t))[:5]
        for (item, tag), s in tags:
            if tag in best and item not in {r[1] for r in ratings if r[0] == u}:
                found.setdefault(item, []).append(s)
        rows = sorted((-len(x), -round(sum(x) / len(x), 9), i) for i, x in found.items())[:4]
        want += [(u, i, -k, -s, r + 1) for r, (k, s, i) in enumerate(rows)]
    assert sorted(map(tuple, got.select("user", "item", "matched_tags", "avg_tag_score", "rank").collect())) == sorted(want) != []


def test_scores_are_rounded_as_spark_rounds(spark):
    rng = random.Random(5)
    x = [0.0, 1e-9, 0.5e-9, 1.5e-9, 2.5e-9, 0.1234567885, 0.1234567895, -0.1234567885, 1234567.1234567885, 1e13 + 0.5, 2 / 3] + [rng.randrange(10**6) / 10**6 + 0.5e-9 for _ in range(300)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i long, v double")
    want = [r[0] for r in df.orderBy("i").select(F.round("v", 9)).collect()]
    got = postings.rounded(np.array(x))
    assert all((got[i] < got[j]) == (want[i] < want[j]) for i in range(len(x)) for j in range(len(x)))

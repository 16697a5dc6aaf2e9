"""Recommendations by genre: users' scores of sets are added up where the user lies."""

from pyspark.sql import functions as F
from test_cycles import shuffled_rows

from sparrowyard.operators import recommend


def test_scores_of_sets_are_not_shuffled(spark):
    genres = spark.range(900).select("id", F.explode(F.array(F.concat(F.lit("t"), F.col("id") % 30), F.concat(F.lit("b"), (F.col("id") / 30).cast("int"))))).toDF("item", "genre")
    ratings = spark.range(6000).select((F.col("id") % 300).alias("user"), (F.xxhash64("id") % 900).alias("item"), (F.col("id") % 7).cast("double").alias("rating")).where("item >= 0")
    n, rows = shuffled_rows(spark, lambda: recommend.by_genre(ratings, genres).count())
    assert n == 2990 and rows < 60_000


def test_genre_scores_by_hand(spark):
    genres = [(i, g) for i in range(40) for g in {f"a{i % 4}", f"b{i % 3}", "c" if i % 5 == 0 else f"a{i % 4}"}]
    ratings = [(u, (u * 7 + 3 * k) % 40, float((u + k) % 6)) for u in range(12) for k in range(9)] + [(3, 2, 5.0), (3, 2, 5.0)]
    of, want = {}, []
    for i, g in genres:
        of.setdefault(i, set()).add(g)
    for u in range(12):
        likes = [i for v, i, r in ratings if v == u and r >= 4]
        seen = {i for v, i, _ in ratings if v == u}
        scored = [(-sum(len(of[i] & of[j]) for j in likes), i, len(of[i] & {g for j in likes for g in of[j]})) for i in of if i not in seen]
        want += [(u, i, -s, g, k + 1) for k, (s, i, g) in enumerate(sorted(x for x in scored if x[0])[:10])]
    got = recommend.by_genre(spark.createDataFrame(ratings, "user long, item long, rating double"), spark.createDataFrame(genres, "item long, genre string"))
    assert sorted(map(tuple, got.select("user", "item", "score", "genres", "rank").collect())) == sorted(want)

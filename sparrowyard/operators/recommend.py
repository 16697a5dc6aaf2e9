"""Recommenders over ``ratings(user, item, rating)``: all are joins keyed by user or item, so a single user is a filter.

Ties in a score are cut by item id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparrowyard.operators import postings
from sparrowyard.operators.graph import cut, global_rank
from sparrowyard.operators.relational import unseen


def _top(scored: DataFrame, n: int, *order) -> DataFrame:
    w = Window.partitionBy("user").orderBy(*order, F.col("item"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def by_genre(ratings: DataFrame, genres: DataFrame, n: int = 10, liked: float = 4.0) -> DataFrame:
    """Unseen items by the number of (liked item, shared genre) paths, per user.

    Items with the same set of genres have the same score for a user, so users are scored against sets. Of a
    set only its first unseen items can be among the n best: as many as n plus what the user has seen of it. They
    are fetched by blocks of n items, so a large set is never paired with all users.
    """
    ratings = cut(ratings.select("user", "item", "rating"))
    one = genres.select("item", "genre").distinct()
    named = cut(one.groupBy("item").agg(F.sort_array(F.collect_list("genre")).alias("genres")))
    sizes = cut(global_rank(named.groupBy("genres").agg(F.count("*").alias("size")), [F.col("genres")]).withColumnRenamed("rank", "set"))
    sets = cut(named.join(sizes.select("genres", "set"), "genres").select("item", "set"))
    # one shuffle by user: what the user likes and has seen of each set, then the sets that share a genre, are added up where the user lies
    rated = ratings.join(sets, "item").repartition("user").groupBy("user", "item", "set").agg(F.count_if(F.col("rating") >= liked).alias("paths"))
    own = rated.groupBy("user", "set").agg(F.sum("paths").alias("paths"), F.count("*").alias("seen"))
    none, no_set = F.lit(None).cast(one.schema["genre"].dataType), F.lit(None).cast("long")
    liked_of = F.when(F.col("paths") > 0, F.transform("genres", lambda g: F.struct(g.alias("genre"), no_set.alias("of"), F.col("paths").alias("n")))).otherwise(F.array())
    keys = F.concat(liked_of, F.array(F.struct(none.alias("genre"), F.col("set").alias("of"), F.col("seen").alias("n"))))
    asked = own.join(sizes.select("set", "genres"), "set").select("user", F.explode(keys).alias("k")).select("user", "k.*").groupBy("user", "genre", "of").agg(F.sum("n").alias("n"))
    by_key = cut(sizes.select(F.explode("genres").alias("genre"), no_set.alias("of"), "set", "size").unionByName(sizes.select(none.alias("genre"), F.col("set").alias("of"), "set", "size")))
    met = asked.join(by_key.withColumnsRenamed({"genre": "g", "of": "o"}), F.col("genre").eqNullSafe(F.col("g")) & F.col("of").eqNullSafe(F.col("o")))
    of_genre = F.col("of").isNull()
    left = met.groupBy("user", "set").agg(
        F.sum(F.when(of_genre, F.col("n"))).alias("score"), F.count_if(of_genre).alias("genres"), F.coalesce(F.sum(F.when(~of_genre, F.col("n"))), F.lit(0)).alias("seen"), F.first("size").alias("size"),
    ).where("score is not null")
    better = Window.partitionBy("user").orderBy(F.desc("score")).rangeBetween(Window.unboundedPreceding, -1)
    kept = left.withColumn("better", F.coalesce(F.sum(F.col("size") - F.col("seen")).over(better), F.lit(0))).where(F.col("better") < n)
    wanted = kept.select("user", "set", "score", "genres", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("seen") + n - 1) / n))).alias("block"))
    placed = global_rank(sets.select("set", "item"), [F.col("set"), F.col("item")])
    first = placed.groupBy("set").agg(F.min("rank").alias("first"))
    blocks = placed.join(first, "set").select("set", "item", F.floor((F.col("rank") - F.col("first")) / n).alias("block"))
    found = unseen(wanted.join(blocks, ["set", "block"]), ratings.select("user", "item").distinct(), ["user", "item"])
    return _top(found.select("user", "item", "score", "genres"), n, F.desc("score"))


def collaborative(ratings: DataFrame, users: DataFrame, n: int = 10, liked: float = 4.0, block: int = 2000) -> DataFrame:
    """Items that users with shared likes like and the user has not rated: similar users, then mean rating over paths.

    The score counts every other user who shares a like, so a popular item does bring all its users together.
    Its users are cut into blocks of about ``block``, and pairs of blocks meet in tasks of their own, with counts
    added up before the shuffle; so no task holds more than the pairs of two blocks of an item.
    """
    ratings = cut(ratings.select("user", "item", "rating"))
    likes = ratings.where(F.col("rating") >= liked)
    degree = likes.groupBy("item").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = likes.join(degree, "item").withColumn("own", F.pmod(F.xxhash64("user"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    mine = dealt.join(users.select("user"), "user", "left_semi").select("user", "item", F.col("own").alias("a"), every.alias("b"))
    others = dealt.select(F.col("user").alias("other"), "item", every.alias("a"), F.col("own").alias("b"))
    paths = mine.join(others, ["item", "a", "b"]).where("user <> other").groupBy("user", "other").agg(F.count("*").alias("shared"))
    # what a user has rated comes as rows among the candidates: one shuffle by user serves leaving it out, the scores and the ranks
    found = paths.join(likes.select(F.col("user").alias("other"), "item", "rating"), "other").select("user", "item", "rating", "shared", F.lit(False).alias("seen"))
    rated = ratings.where("item is not null").join(users.select("user"), "user", "left_semi")
    rows = found.unionByName(rated.select("user", "item", F.lit(None).cast(ratings.schema["rating"].dataType).alias("rating"), F.lit(None).cast("long").alias("shared"), F.lit(True).alias("seen")))
    mean = F.sum(F.col("rating") * F.col("shared")) / F.sum("shared")
    scored = rows.repartition("user").groupBy("user", "item").agg(F.count("*").alias("similar_users"), mean.alias("mean_rating"), F.max("seen").alias("seen"))
    return _top(scored.where("not seen").drop("seen"), n, F.desc("similar_users"), F.desc(F.round("mean_rating", 6)))


def by_tags(ratings: DataFrame, tags: DataFrame, n: int = 10, n_tags: int = 20, min_score: float = 0.5, liked: float = 4.0, paired_up_to: int = 64, listed: int = postings.LISTED, asked: int = postings.ASKED) -> DataFrame:
    """Per user: the tags with the best mean score over liked items, then unseen items by matched tags and mean score.

    An item's tags travel as one row. Users go, with their chosen tags and what they have seen there, to the blocks of items in which
    one of the tags stands, where matches are counted and ranked (``operators.postings``); only the ``n`` best of a user and block
    are shuffled. Rows of an item and tag are added up first. ``paired_up_to`` changes nothing any more; callers may still pass it.
    """
    ratings = cut(ratings.select("user", "item", "rating"))
    strong = tags.where(F.col("score") >= min_score).groupBy("tag", "item").agg(F.sum(F.col("score").cast("double")).alias("total"), F.count("*").alias("rows"))
    whole = cut(strong.where("item is not null").groupBy("item").agg(F.collect_list(F.struct("tag", "total", "rows")).alias("l")).select("item", F.col("l.tag").alias("tags"), F.col("l.total").alias("totals"), F.col("l.rows").alias("rows")))
    places = whole.agg(F.sum(F.size("tags"))).first()[0] or 0
    lists = cut(whole.repartitionByRange(max(1, -(-places // listed)), "item").withColumn("block", F.spark_partition_id()))
    likes = ratings.where(F.col("rating") >= liked).join(whole, "item").where("user is not null").select("user", "tags", "totals", "rows").repartition("user")
    mine = likes.select("user", F.inline(F.arrays_zip("tags", "totals", "rows")).alias("tag", "total", "n")).groupBy("user", "tag").agg(F.round(F.sum("total") / F.sum("n"), 9).alias("relevance"))
    w = Window.partitionBy("user").orderBy(F.desc("relevance"), "tag")
    kept = mine.withColumn("i", F.row_number().over(w)).where(F.col("i") <= n_tags).groupBy("user").agg(F.collect_list("tag").alias("tags"))
    seen = ratings.select("user", "item").repartition("user").groupBy("user").agg(F.collect_set("item").alias("seen"))
    users = cut(kept.join(seen, "user"))
    # Spark takes an exploded table for no larger than its input, and would broadcast hundreds of megabytes
    where = lists.select("block", F.explode("tags").alias("x")).distinct()
    to = cut(users.select("user", F.explode("tags").alias("x")).hint("merge").join(where, "x").select("user", "block").distinct())
    ends = lists.groupBy("block").agg(F.min("item").alias("low"), F.max("item").alias("high"))
    blocks = F.broadcast(cut(to.groupBy("block").agg(F.ceil(F.count("*") / asked).cast("int").alias("parts")).join(ends, "block")))
    part = F.pmod(F.xxhash64("user"), F.col("parts")).cast("int").alias("part")
    asking = users.join(to, "user").join(blocks, "block").select("block", part, "user", "tags", F.filter("seen", lambda i: i.between(F.col("low"), F.col("high"))).alias("seen"))
    items = lists.join(blocks, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "item", "tags", "totals", "rows")
    scored = postings.best(items, asking, n).select("user", "item", "matched_tags", F.round(F.col("total") / F.col("rows"), 9).alias("avg_tag_score"))
    return _top(scored, n, F.desc("matched_tags"), F.desc("avg_tag_score"))


def items_with_genres(genres: DataFrame) -> DataFrame:
    return genres.select("item", "genre").distinct().groupBy("item").agg(F.sort_array(F.collect_list("genre")).alias("genres"))


def user_ratings(ratings: DataFrame, user: int, n: int = 50) -> DataFrame:
    return ratings.where(F.col("user") == user).orderBy(F.desc("rating"), "item").limit(n)


def build_catalog(movies: DataFrame, tag_scores: DataFrame) -> dict[str, DataFrame]:
    """Nodes and edges of the catalog from ``movies(item, title, genres, at)`` and ``tag_scores(item, tag, score, at)``.

    The row with the greatest ``at`` wins per key; genres are split at ``|``; tag edges need their item.
    """
    last = lambda df, keys: df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), "at").alias("r")).select("r.*").drop("at")
    items = last(movies, ["item"])
    genres = items.select("item", F.explode(F.split("genres", r"\|")).alias("genre")).where("genre <> ''").distinct()
    tags = last(tag_scores, ["item", "tag"]).join(items.select("item"), "item", "left_semi")
    return {"item": items.drop("genres"), "genre": genres.select("genre").distinct(), "tag": tags.select("tag").distinct(), "has_genre": genres, "has_tag": tags}


def catalog_counts(catalog: dict[str, DataFrame]) -> DataFrame:
    """Rows of each label."""
    one = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("label"), "n") for name, df in catalog.items()]
    out = one[0]
    for df in one[1:]:
        out = out.union(df)
    return out

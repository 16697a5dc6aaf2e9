"""What large inputs need: partitions by rows, no broadcast of packed tables, trailing sums and overlaps whose work is bounded."""

import random

from pyspark.sql import functions as F

from sparrowyard import session
from sparrowyard.operators import graph, recommend
from sparrowyard.operators import relational as R


def test_shuffles_follow_the_rows_and_packed_tables_are_not_broadcast(spark, tmp_path):
    names = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.sources.fileCompressionFactor"]
    was = {k: spark.conf.get(k) for k in names}
    try:
        spark.range(1_500_000).selectExpr("id", "id % 7 as x").write.parquet(str(tmp_path / "t"))
        df = session.spread(spark.read.parquet(str(tmp_path / "t")))
        assert int(spark.conf.get(names[0])) == 15 and session._bytes(spark.conf.get(names[1])) == session.TASK_BYTES
        plan = df.join(df.withColumnRenamed("x", "y"), "id")._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan
        session.spread(df.limit(10))
        assert int(spark.conf.get(names[0])) == 15
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_trailing_counts_rows_of_a_crowded_span(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([1, 2, None]), rng.choice([None, *range(0, 3000, 7)]), rng.choice([None, -3, 4, 50])) for i in range(900)]
    got = {r.id: (r.n_trailing, r.sum_trailing) for r in R.trailing(spark.createDataFrame(rows, "id long, key long, ms long, v long"), "key", "ms", 500, "v").collect()}
    for i, key, ms, _ in rows:
        near = [r for r in rows if r[1] == key and (r[2] is ms is None or None not in (r[2], ms) and ms - 500 <= r[2] <= ms)]
        known = [r[3] for r in near if r[3] is not None]
        assert got[i] == (len(near), sum(known) if known else None)


def test_trailing_sums_run_and_do_not_slide(spark):
    plan = R.trailing(spark.range(10).select("id", F.lit(1).alias("key"), F.col("id").alias("ms")), "key", "ms", 5, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "RangeFrame" not in plan and "unboundedpreceding" in plan


def test_overlaps_come_once_from_blocks(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["x", "y", None]), a := rng.randrange(3000), a + rng.randrange(1500)) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, g string, a int, b int").select("id", "g", F.date_add(F.lit("2000-01-01"), "a").alias("s"), F.date_add(F.lit("2000-01-01"), "b").alias("e"))
    got = sorted(map(tuple, R.overlap_pairs(df, "id", "g", "s", "e", block=20).collect()))
    assert got == sorted((x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and x[1] == y[1] and x[1] and x[2] <= y[3] and y[2] <= x[3])
    made = R.overlap_pairs(df, "id", "g", "s", "e", block=20)._jdf.queryExecution().optimizedPlan().toString()
    assert "blocks" in made


def test_collaborative_leaves_rated_items_out_without_a_join(spark):
    rows = spark.createDataFrame([(1, 1, 5.0), (1, 2, 5.0), (2, 1, 5.0), (2, 3, 4.5), (2, None, 5.0), (1, None, 1.0)], "user long, item long, rating double")
    got = recommend.collaborative(rows, rows.select("user").distinct())
    assert sorted((r.user, str(r.item), r.similar_users) for r in got.collect()) == [(1, "3", 1), (1, "None", 1), (2, "2", 1)]
    assert "LeftAnti" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_of_tags_are_not_broadcast(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(recommend, "cut", lambda df, cut=recommend.cut: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    rows = [(u, i, 4.5) for u in range(4) for i in range(4) if (u + i) % 3]
    tags = [(i, t, 0.9) for i in range(4) for t in range(3)]
    assert recommend.by_tags(spark.createDataFrame(rows, "user long, item long, rating double"), spark.createDataFrame(tags, "item long, tag long, score double")).count() == 6
    assert any("SortMergeJoin [x#" in p for p in plans) and not any("BroadcastHashJoin [x#" in p for p in plans)


def test_edges_in_buckets_are_not_shuffled_by_the_rounds(spark):
    rows = spark.range(1000).selectExpr("id % 100 as node", "id as to")
    e = graph.bucketed(rows, "node")
    joined = spark.range(100).selectExpr("id as node").hint("merge").join(e, "node")
    assert joined._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, joined.select("node", "to").collect())) == sorted(map(tuple, rows.collect()))
    line = spark.createDataFrame([(i, i + 1, 1.0) for i in range(12)], "src long, dst long, w double")
    found = graph.shortest_paths(line, spark.createDataFrame([(0,), (5,)], "id long")).collect()
    assert sorted((r.source, r.node, r.dist) for r in found) == [(s, n, float(n - s)) for s in (0, 5) for n in range(s, 13)]
    assert graph.shortest_paths(line.limit(0), spark.createDataFrame([(3,)], "id long")).collect() == [(3, 3, 0.0)]

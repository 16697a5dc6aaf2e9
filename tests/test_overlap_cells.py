"""Overlaps of a large group are found in cells of two blocks, so a row is sent to the root of its group's size."""

from pyspark.sql import functions as F
from test_cycles import shuffled_rows, unicast  # noqa: F401

from sparrowyard.operators import relational as R


def test_rows_are_sent_to_few_cells(spark, unicast):  # noqa: F811
    days = lambda c: F.date_add(F.lit("2001-01-05"), F.col(c).cast("int"))
    df = spark.range(2000).selectExpr("id", "1 as g", "id % 40 as a", "id % 40 + id % 7 as b").select("id", "g", days("a").alias("s"), days("b").alias("e"))
    want = {(i, j) for i in range(2000) for j in range(i + 1, 2000) if i % 40 <= j % 40 + j % 7 and j % 40 <= i % 40 + i % 7}
    got, rows = shuffled_rows(unicast, lambda: R.overlap_pairs(df, "id", "g", "s", "e", block=20).collect())
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert rows < 60_000

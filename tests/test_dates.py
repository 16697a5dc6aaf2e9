"""Patterns of mixed date columns from one scan."""

import datetime

from pyspark.sql import functions as F

from sparrowyard.operators import dates
from sparrowyard.sources import files


def test_patterns_of_mixed_columns(spark):
    rows = [
        ("2024-01-31", "31/01/2024", "01/02/2024 10:05:00", "12 Jan 2024", "a-1 b", None), ("2024-02-01", "02/12/2024", "12/31/2024 23:59:59", "Feb 3, 2024", "2024-99", None),
        ("2024/3/1", "5/6/2024", "31/12/2024 00:00:01", "1 March 2024", "10.0.0.1", None), (" 2024-03-04T05:06:07Z ", "17/7/2024", "1/1/2024 1:05 PM", "jan 9, 2024", "call 1-2-3", None),
    ]
    df = spark.createDataFrame(rows, "iso string, dayfirst string, both string, named string, text string, none string")
    got = {}
    for r in dates.date_formats(df).collect():
        got.setdefault(r.column, {})[r.pattern] = r.n
    assert got == {
        "iso": {"yyyy-M-d": 2, "yyyy/M/d": 1, "yyyy-M-d'T'H:mm:ssXXX": 1}, "dayfirst": {"d/M/yyyy": 3, "M/d/yyyy": 1}, "both": {"M/d/yyyy H:mm:ss": 3, "d/M/yyyy H:mm:ss": 3, "M/d/yyyy h:mm a": 1},
        "named": {"d MMM yyyy": 2, "MMM d, yyyy": 2}, "text": {None: 4},
    }
    both = sorted((p for p in got["both"]), key=lambda p: p[0] == "d")  # month first where both can be
    at = [r[0] for r in df.select(dates.parsed(F.col("both"), both)).collect()]
    assert at == [datetime.datetime(2024, 1, 2, 10, 5), datetime.datetime(2024, 12, 31, 23, 59, 59), datetime.datetime(2024, 12, 31, 0, 0, 1), datetime.datetime(2024, 1, 1, 13, 5)]
    assert dates.date_formats(df.select("none")).count() == 0 and dates.date_formats(spark.range(3)).count() == 0


def test_all_columns_take_one_scan(spark, tmp_path):
    spark.range(50).select(F.lit("2024-01-02").alias("a"), F.lit("x").alias("b")).write.parquet(f"{tmp_path}/t")
    jobs = spark.sparkContext.statusTracker()
    df = spark.read.parquet(f"{tmp_path}/t")
    spark.sparkContext.setJobGroup("dates", "dates")
    found = dates.date_formats(df)
    n = len(jobs.getJobIdsForGroup("dates"))
    spark.sparkContext.setJobGroup("other", "other")
    assert n <= 2 and {tuple(r) for r in found.collect()} == {("a", "yyyy-M-d", 50), ("b", None, 50)}


def test_json_with_inferred_schema(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a": 1, "b": {"c": "d"}}\n\n{"a": 2.5}\n')
    got = files.read_ndjson(spark, str(tmp_path / "x.json"))
    assert dict(got.dtypes) == {"a": "double", "b": "struct<c:string>"} and got.count() == 2
    assert files.read_ndjson(spark, str(tmp_path / "missing.json")).count() == 0

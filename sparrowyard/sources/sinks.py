"""Writers with a check or a report, and files put together up to a size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from sparrowyard.sources.files import read_csv


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_parquet_checked(df: DataFrame, path: str) -> int:
    """Rows written; the written table must hold as many, with the same columns."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
    back = df.sparkSession.read.parquet(path)
    rows = back.count()
    if rows != seen.get["rows"] or back.columns != df.columns:
        raise RuntimeError(f"{path} holds {rows} rows with {back.columns}, written were {seen.get['rows']} with {df.columns}")
    return rows


def listing(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """``path, bytes`` of files, without their content."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return found.select("path", F.col("length").alias("bytes"))


def csv_to_parquet(spark: SparkSession, src: str, dst: str, rows_per_file: int) -> DataFrame:
    """Parquet files of at most so many rows each, and their sizes."""
    read_csv(spark, src).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(dst)
    return listing(spark, dst, "*.parquet")


def files_to_size(spark: SparkSession, path: str, glob: str, target: int) -> DataFrame:
    """The first files by name until they reach the target's bytes (the file that reaches it included).

    The window runs over a directory's listing: one small row a file.
    """
    before = F.coalesce(F.sum("bytes").over(Window.partitionBy(F.lit(0)).orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return listing(spark, path, glob).withColumn("before", before).where(F.col("before") < target).drop("before")


def concat_to_size(spark: SparkSession, path: str, glob: str, out: str, target: int) -> int:
    """One CSV table from files of the same columns, up to a size; returns its rows."""
    chosen = [r.path for r in files_to_size(spark, path, glob, target).collect()]
    if not chosen:
        return 0
    seen = Observation()
    write_csv(spark.read.option("header", True).csv(chosen).observe(seen, F.count(F.lit(1)).alias("rows")), out)
    return seen.get["rows"]

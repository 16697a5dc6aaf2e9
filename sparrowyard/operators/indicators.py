"""Exponential averages of price histories, per key and in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bounded_history(df: DataFrame, key: str, order: str, keep: int = 50) -> DataFrame:
    """The newest ``keep`` rows of each key."""
    return df.withColumn("back", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("back") <= keep).drop("back")


def _folded(df: DataFrame, key: str, order: str, value: str):
    return df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("v"))


def ema(df: DataFrame, key: str, order: str, value: str, span: int = 9, keep: int = 50, warmup: int = 14) -> DataFrame:
    """EMA of the bounded history (so a key's list has ``keep`` values at most), seeded with its first value."""
    a = 2.0 / (span + 1)
    lists = _folded(bounded_history(df, key, order, keep), key, order, value).where(F.size("v") >= warmup)
    return lists.select(key, F.aggregate(F.slice("v", 2, keep), F.get("v", F.lit(0)), lambda s, x: s * (1 - a) + x * a).alias("ema"))


def rsi(df: DataFrame, key: str, order: str, value: str, n: int = 14, keep: int = 50) -> DataFrame:
    """RSI by Wilder's averages seeded with the first difference; no loss gives 100, no move null."""
    lists = _folded(bounded_history(df, key, order, keep), key, order, value).where(F.size("v") >= n)
    diffs = lists.select(key, F.transform(F.slice("v", 2, keep), lambda x, i: x - F.get("v", i)).alias("d"))
    up, down = lambda d: F.greatest(d, F.lit(0.0)), lambda d: F.greatest(-d, F.lit(0.0))
    first = F.get("d", F.lit(0))
    start = F.struct(up(first).alias("g"), down(first).alias("l"))
    mean = lambda s, x: s * (1 - 1.0 / n) + x * (1.0 / n)
    s = F.aggregate(F.slice("d", 2, keep), start, lambda a, d: F.struct(mean(a["g"], up(d)).alias("g"), mean(a["l"], down(d)).alias("l")))
    s = diffs.select(key, s.alias("s"))
    return s.select(key, F.when(F.col("s.l") > 0, 100 - 100 / (1 + F.col("s.g") / F.col("s.l"))).when(F.col("s.g") > 0, 100.0).alias("rsi"))

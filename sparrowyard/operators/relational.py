"""Joins, aggregates, windows, top-k and set operations as ``DataFrame -> DataFrame`` functions.

Ties get a total order wherever rows are cut. Nothing here collects data or forces a broadcast of a table of
unknown size: Spark broadcasts what it measures to be small.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowyard.operators import selection


# projection and filter
def drop_sensitive(df: DataFrame, pattern: str = "login|cpf|cnpj") -> DataFrame:
    """Without columns whose name matches; all stay if all match."""
    keep = [c for c in df.columns if not re.search(pattern, c, re.I)]
    return df.select(*(keep or df.columns))


def flatten_json(df: DataFrame, col: str, schema: str) -> DataFrame:
    return df.withColumn("data", F.from_json(col, schema)).select(*[c for c in df.columns if c != col], "data.*")


def keep_in(df: DataFrame, col: str, values: DataFrame) -> DataFrame:
    return df.join(values.select(F.col(values.columns[0]).alias(col)).distinct(), col, "left_semi")


# joins
def enrich_left(df: DataFrame, dim: DataFrame, on) -> DataFrame:
    return df.join(dim, on, "left")


def flag_members(df: DataFrame, col: str, keys: DataFrame, name: str) -> DataFrame:
    """``yes`` where the key is in ``keys``, else ``no``."""
    marks = keys.select(F.col(keys.columns[0]).alias(col)).distinct().withColumn(name, F.lit("yes"))
    return df.join(marks, col, "left").withColumn(name, F.coalesce(name, F.lit("no")))


def unseen(candidates: DataFrame, seen: DataFrame, on) -> DataFrame:
    return candidates.join(seen, on, "left_anti")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes.id``."""
    ends = nodes.select("id").distinct()
    return edges.join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def diff_by_key(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Full outer reconciliation: a missing side counts as 0."""
    left, right = a.select(key, F.col(value).alias("a_value")), b.select(key, F.col(value).alias("b_value"))
    zero = F.lit(0).cast("bigint")
    joined = left.join(right, key, "full_outer").withColumn("a_value", F.coalesce("a_value", zero)).withColumn("b_value", F.coalesce("b_value", zero))
    return joined.withColumn("diff", F.col("a_value") - F.col("b_value"))


def reconciled(a: DataFrame, b: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Two results of the same keys: the divergent rows, and one row about all.

    A key is divergent if one side lacks it or the values differ; ``diff`` is a's value less b's, a missing one as 0. The row has
    ``n_a, n_b, n_all, divergent, sum_abs_diff`` and ``same``, true without divergent keys.
    """
    left, right = a.select(key, F.col(value).alias("a_value")), b.select(key, F.col(value).alias("b_value"))
    both = left.withColumn("_a", F.lit(1)).join(right.withColumn("_b", F.lit(1)), key, "full_outer")
    zero = F.lit(0).cast("bigint")
    both = both.withColumn("diff", F.coalesce("a_value", zero) - F.coalesce("b_value", zero)).withColumn("off", F.col("_a").isNull() | F.col("_b").isNull() | ~F.col("a_value").eqNullSafe(F.col("b_value")))
    report = both.agg(
        F.count("_a").alias("n_a"), F.count("_b").alias("n_b"), F.count("*").alias("n_all"), F.count_if("off").alias("divergent"),
        F.coalesce(F.sum(F.when(F.col("off"), F.abs("diff"))), zero).alias("sum_abs_diff"), (F.count_if("off") == 0).alias("same"),
    )
    return both.where("off").select(key, "a_value", "b_value", "diff"), report


def overlap_pairs(df: DataFrame, id: str, group: str, start: str, end: str, bucket_days: int = 365, block: int = 2000) -> DataFrame:
    """Pairs ``a < b`` of a group whose intervals overlap.

    Every interval is listed under the buckets of days that it touches, and meets there those that begin in the
    bucket: of a pair the later one (ties by id) has one beginning, so the pair comes up once and in no other bucket.
    Of a large group, of which there may be as many pairs as its square, both sides are cut into blocks that meet in cells of
    their own. With n beginnings there are sqrt(n / ``block``) blocks a side, so a row is sent that many times, and tasks keep
    sqrt(n * ``block``) rows in memory.
    """
    from sparrowyard.operators.graph import cut

    day = lambda c: F.floor(F.unix_date(F.col(c).cast("date")) / bucket_days)
    rows = cut(df.select(F.col(id).alias("id"), F.col(group).alias("g"), F.col(start).alias("s"), F.col(end).alias("e")).where("g is not null and s is not null and e is not null"))
    late = rows.withColumn("k", day("s"))
    sizes = cut(late.groupBy("g", "k").agg(F.ceil(F.sqrt(F.count("*") / block)).cast("int").alias("blocks")))
    own, every = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    late = late.join(sizes, ["g", "k"]).select("g", "k", own.alias("p"), every.alias("q"), F.col("id").alias("late"), F.col("s").alias("from"), F.col("e").alias("to"))
    others = rows.withColumn("k", F.explode(F.sequence(day("s"), day("e")))).join(sizes, ["g", "k"]).select("g", "k", every.alias("p"), own.alias("q"), "id", "s", "e")
    before = (F.col("s") < F.col("from")) | ((F.col("s") == F.col("from")) & (F.col("id") < F.col("late")))
    found = others.join(late, ["g", "k", "p", "q"]).where(before & (F.col("id") != F.col("late")) & (F.col("from") <= F.col("e")) & (F.col("s") <= F.col("to")))
    return found.select(F.least("id", "late").alias("a"), F.greatest("id", "late").alias("b"))


# aggregates
def group_rate(df: DataFrame, keys: list[str], measures: dict[str, str], cond: Column, rate: str) -> DataFrame:
    """Count, means and the percentage of rows that meet ``cond``."""
    means = [F.avg(c).alias(n) for n, c in measures.items()]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *means, (F.sum(F.when(cond, 1).otherwise(0)) / F.count("*") * 100).alias(rate))


def two_level(df: DataFrame, inner: list[str], outer: str, measure: str) -> DataFrame:
    """Mean over the inner groups' means and sums, unweighted."""
    first = df.groupBy(*inner).agg(F.sum(measure).alias("total"), F.avg(measure).alias("mean"))
    return first.groupBy(outer).agg(F.count(inner[0]).alias("n"), F.avg("total").alias("avg_total"), F.avg("mean").alias("avg_mean"))


def null_profile(df: DataFrame) -> DataFrame:
    """Row count and nulls of each column, in one scan, as ``column, nulls, total``."""
    one = df.agg(F.count("*").alias("t"), *[F.sum(F.col(c).isNull().cast("bigint")).alias(f"n_{i}") for i, c in enumerate(df.columns)])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n_{i}").alias("nulls"), F.col("t").alias("total")) for i, c in enumerate(df.columns)])
    return one.select(F.inline(cells))


def numeric_profile(df: DataFrame, cols: list[str], rsd: float = 0.05, exact: bool = False) -> DataFrame:
    """Extremes, mean, both standard deviations and distinct count of numeric columns, in one scan.

    The distinct count is approximate unless ``exact``, which shuffles the distinct values.
    """
    ndv = F.count_distinct if exact else lambda c: F.approx_count_distinct(c, rsd)
    figures = {"min": F.min, "max": F.max, "mean": F.avg, "std_samp": F.stddev_samp, "std_pop": F.stddev_pop, "ndv": ndv}
    one = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}_{i}") for i, c in enumerate(cols) for n, f in figures.items()])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{n}_{i}").alias(n) for n in figures]) for i, c in enumerate(cols)])
    return one.select(F.inline(cells))


def _few(df: DataFrame, cols: list[str], most: int) -> dict[str, int]:
    """Approximate distinct values of the columns that may have up to ``most``, by a margin of six deviations."""
    if not cols:
        return {}
    one = df.agg(*[F.approx_count_distinct(F.col(c).cast("string"), 0.02).alias(f"n_{i}") for i, c in enumerate(cols)]).first()
    return {c: n for c, n in zip(cols, one, strict=True) if n <= most * 1.12 + 2}


def _values(df: DataFrame, cols: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])
    return df.select(F.inline(pairs)).groupBy("column", "value").agg(F.count("*").alias("n"))


def value_counts(df: DataFrame, cols: list[str], max_ndv: int = 50) -> DataFrame:
    """Counts of the values of columns with few of them: one pass for all columns.

    An approximate count rules columns of many values out first, so their values are never shuffled; the exact
    limit is tested on the rest.
    """
    cols = [*_few(df, cols, max_ndv)]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, value string, n bigint")
    counts = _values(df, cols)
    few = counts.groupBy("column").agg(F.count("*").alias("ndv")).where(F.col("ndv") <= max_ndv)
    return counts.join(few, "column", "left_semi")


def unique_values(df: DataFrame, cols: list[str], max_listed: int = 20, sample: int = 5) -> DataFrame:
    """``column, listed, ndv, values`` (as text, in order, without null): all values if there are few, else the first few.

    ``ndv`` is exact for listed columns and approximate for others.
    """
    about = df.agg(*[F.approx_count_distinct(F.col(c).cast("string"), 0.02).alias(f"n_{i}") for i, c in enumerate(cols)]).first()
    parts = []
    for c, n in zip(cols, about, strict=True):
        # the rows that are kept are max_listed + 1 at most, by partial limits
        first = df.select(F.col(c).cast("string").alias("value")).where("value is not null").distinct().orderBy("value").limit(max(max_listed + 1, sample))
        one = first.agg(F.count("*").alias("k"), F.array_sort(F.collect_list("value")).alias("v"))
        listed = F.col("k") <= max_listed
        parts.append(one.select(F.lit(c).alias("column"), listed.alias("listed"), F.when(listed, F.col("k")).otherwise(F.lit(n).cast("long")).alias("ndv"), F.when(listed, F.col("v")).otherwise(F.slice("v", 1, sample)).alias("values")))
    return union_all(*parts)


def bucket_quantile(hist: DataFrame, keys: list[str], q: float) -> DataFrame:
    """Quantile from cumulative buckets (``le``, ``n``), linear within a bucket, the first of which begins at 0.

    The widest bucket's count is the total. A quantile in an infinite bucket is the greatest finite bound; no rows give null.
    """
    w = Window.partitionBy(*keys).orderBy("le")
    swept = hist.select(*keys, "le", "n", F.lag("le", 1, 0.0).over(w).alias("low"), F.lag("n", 1, 0).over(w).alias("before"), (F.max("n").over(Window.partitionBy(*keys)) * q).alias("rank"))
    inside = F.col("low") + (F.col("le") - F.col("low")) * F.try_divide(F.col("rank") - F.col("before"), F.col("n") - F.col("before"))
    at = F.when(F.col("le") == float("inf"), F.col("low")).otherwise(inside)
    return swept.groupBy(*keys).agg(F.min_by(F.when(F.col("rank") > 0, at), F.when(F.col("n") >= F.col("rank"), F.col("le"))).alias("quantile"))


def group_stats(df: DataFrame, keys: list[str], measure: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(measure).alias("mean"), F.sum(measure).alias("total"))


def percentiles(df: DataFrame, keys: list[str], col: str, ps: list[float], ordered: int = selection.ORDERED) -> DataFrame:
    """Interpolated percentiles, as ``p50`` and so on.

    Groups of up to ``ordered`` values are ordered by Spark's aggregate in one task each; larger ones find the two
    neighbours of each place by ``selection.order_statistics``.
    """
    if selection.largest(df, keys, col) <= ordered:
        return df.groupBy(*keys).agg(*[F.percentile(col, F.lit(p)).alias(f"p{round(p * 100)}") for p in ps])
    at = {p: lambda n, p=p: F.lit(p) * (n - 1) for p in ps}
    ranks = {f"{side}{k}": (lambda n, f=at[p], g=g: g(f(n)).cast("long")) for k, p in enumerate(ps) for side, g in (("low", F.floor), ("high", F.ceil))}
    found = selection.order_statistics(df, keys, col, ranks, ordered)
    part = lambda p: at[p](F.col("n")) - F.floor(at[p](F.col("n")))
    between = lambda k, p: F.col(f"low{k}") * (1 - part(p)) + F.col(f"high{k}") * part(p)
    return found.select(*keys, *[between(k, p).alias(f"p{round(p * 100)}") for k, p in enumerate(ps)])


def status_counts(df: DataFrame, col: str, done: str) -> DataFrame:
    """Rows, rows with the final status, and rows with another one."""
    return df.agg(F.count("*").alias("n"), F.count_if(F.col(col) == done).alias("done"), F.count_if(F.col(col) != done).alias("still_open"))


def trip_stats(df: DataFrame, col: str, least: float) -> DataFrame:
    """Trips, those below the least plausible value, those without one, and the mean."""
    return df.agg(F.count("*").alias("trips"), F.count_if(F.col(col) < least).alias("anomalies"), F.count_if(F.col(col).isNull()).alias("invalid"), F.avg(col).alias("mean"))


def pivot_mean(df: DataFrame, key: str, col: str, values: list, measure: str) -> DataFrame:
    """One column of means per given value."""
    return df.groupBy(key).pivot(col, values).agg(F.avg(measure))


def distinct_counts(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    return df.agg(*[F.count_distinct(c).alias(n) for n, c in cols.items()])


def approx_distinct(df: DataFrame, cols: dict[str, str], rsd: float = 0.05) -> DataFrame:
    return df.agg(*[F.approx_count_distinct(c, rsd).alias(n) for n, c in cols.items()])


def users_per_value(df: DataFrame, value: str, user: str) -> DataFrame:
    """Rows and distinct users of each value."""
    return df.groupBy(value).agg(F.count("*").alias("n"), F.count_distinct(user).alias("users"))


def duration_by_class(df: DataFrame, kind: str, minutes: Column) -> DataFrame:
    """Trips and mean minutes per class of rider."""
    return df.groupBy(kind).agg(F.count("*").alias("n"), F.avg(minutes).alias("minutes"))


def bucket_histogram(df: DataFrame, keys: list[str], col: str, bounds: list[float]) -> DataFrame:
    """Cumulative counts of values up to each bound."""
    one = df.groupBy(*keys).agg(*[F.sum((F.col(col) <= b).cast("bigint")).alias(f"b_{i}") for i, b in enumerate(bounds)])
    cells = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b_{i}").alias("n")) for i, b in enumerate(bounds)])
    return one.select(*keys, F.inline(cells))


def config_stats(runs: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """Runs, mean, sample deviation (0 for one run), population deviation."""
    return runs.groupBy(*keys).agg(F.count("*").alias("runs"), F.avg(metric).alias("mean"), F.coalesce(F.stddev_samp(metric), F.lit(0.0)).alias("std"), F.stddev_pop(metric).alias("std_pop"))


#: Two-sided 95 % quantiles of Student's t for 1 to 30 degrees of freedom; beyond them 1.96.
T_95 = (
    12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131,
    2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042,
)


def half_width(stats: DataFrame, runs: str = "runs", std: str = "std") -> DataFrame:
    """With ``ci``, half the 95 % confidence interval of the mean; null for one run."""
    t = F.coalesce(F.get(F.array(*map(F.lit, T_95)), (F.col(runs) - 2).cast("int")), F.lit(1.96))
    return stats.withColumn("ci", F.when(F.col(runs) > 1, t * F.col(std) / F.sqrt(runs)))


def speedup(stats: DataFrame, config: str, workers: str, base, work: Column | None = None) -> DataFrame:
    """Time of the base worker count over each time; efficiency where workers are numbers; throughput of ``work`` units a run."""
    first = stats.where(F.col(workers) == base).select(config, F.col("mean").alias("base_mean"))
    out = stats.join(first, config).withColumn("speedup", F.col("base_mean") / F.col("mean"))
    if not isinstance(base, str):
        out = out.withColumn("efficiency", F.col("speedup") * base / F.col(workers))
    return out if work is None else out.withColumn("throughput", F.try_divide(work, F.col("mean")))


def nearest_rank(df: DataFrame, keys: list[str], col: str, ps: list[float], ordered: int = selection.ORDERED) -> DataFrame:
    """Percentiles at index ``round(p * (n - 1))``, halves to even, of the ordered values; groups of nulls alone are left out.

    Of a group beyond ``ordered`` values no task holds more than so many (see ``selection``).
    """
    ranks = {f"p{round(p * 100)}": (lambda n, p=p: F.bround(F.lit(p) * (n - 1), 0).cast("long")) for p in ps}
    return selection.order_statistics(df, keys, col, ranks, ordered).drop("n")


def ohlcv(trades: DataFrame, keys: list[str], more: list[Column] | None = None) -> DataFrame:
    """Candles: first and last price by trade id, extremes, volumes by side, count and mean, and ``more`` aggregates."""
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("qty")).otherwise(0)).alias(f"{s}_volume")
    return trades.groupBy(*keys).agg(
        F.min_by("price", "trade_id").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "trade_id").alias("close"),
        F.sum("qty").alias("volume"), side("buy"), side("sell"), F.count("*").alias("trades"), F.avg("price").alias("mean_price"), *(more or []),
    )


# windows
def latest_per_key(df: DataFrame, keys: list[str], ts: str, tie: str, n: int | None = None) -> DataFrame:
    """Newest row of each key by aggregation (partial sums, no sort of a key's rows), then the newest n."""
    one = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(ts, tie)).alias("r")).select("r.*")
    return one.orderBy(F.desc(ts), F.desc(tie)).limit(n) if n else one


def trend_score(df: DataFrame, window: str, count: str) -> DataFrame:
    top = df.groupBy(window).agg(F.max(count).alias("top"))
    return df.join(top, window).withColumn("score", F.round(F.col(count) / F.col("top") * 100, 2)).drop("top")


def last_n_windows(df: DataFrame, window: str, n: int) -> DataFrame:
    newest = df.select(window).distinct().orderBy(F.desc(window)).limit(n)
    return df.join(newest, window, "left_semi")


def trailing(df: DataFrame, key: str, ms: str, span: int, value: str) -> DataFrame:
    """Count and sum over the trailing ``span`` milliseconds of each key, peers included.

    Rows of a key and time are added up first. These moments are dealt out by key and period of ``span``, each also as
    history of the next period, so a key's rows are spread over its periods instead of meeting in one task. A running
    sum per period then gives a moment's figures less those before its span, so the work does not grow with
    the rows in a span. ``value`` is an integer or a decimal, of which sums are exact.
    """
    at = df.groupBy(F.col(key).alias("_key"), F.col(ms).alias("_ms")).agg(F.count("*").alias("_n"), F.count(value).alias("_known"), F.sum(value).alias("_sum"))
    period = F.floor(F.col("_ms") / span)
    none = F.lit(0).cast("long")
    row = lambda k, time, kind, past, *x: F.struct(k.alias("k"), time.alias("time"), F.lit(kind).alias("kind"), F.lit(past).alias("past"), *[c.alias(n) for c, n in zip(x, ("n", "known", "sum"), strict=True)])
    total = F.coalesce("_sum", F.lit(0).cast(at.schema["_sum"].dataType))
    adds = [row(period + late, F.col("_ms"), 1, bool(late), F.col("_n"), F.col("_known"), total) for late in (0, 1)]
    ask = row(period, F.col("_ms") - span, 0, False, none, none, F.lit(0).cast(at.schema["_sum"].dataType))
    dealt = at.select("_key", "_ms", F.explode(F.array(*adds, ask)).alias("_x")).select("_key", "_ms", "_x.*").where("_ms is not null or not past")
    w = Window.partitionBy("_key", "k").orderBy("time", "kind").rowsBetween(Window.unboundedPreceding, 0)
    sign = F.when(F.col("kind") == 1, 1).otherwise(-1)
    run = dealt.select("_key", "k", "_ms", "past", *[(F.sum(c).over(w) * sign).alias(c) for c in ("n", "known", "sum")]).where("not past")
    found = run.groupBy("_key", "k", "_ms").agg(*[F.sum(c).alias(c) for c in ("n", "known", "sum")])
    found = found.select("_key", "_ms", F.col("n").alias("n_trailing"), F.when(F.col("known") > 0, F.col("sum")).alias("sum_trailing"))
    return df.join(found, df[key].eqNullSafe(found["_key"]) & df[ms].eqNullSafe(found["_ms"])).drop("_key", "_ms")


def id_gaps(df: DataFrame, key: str, id: str) -> DataFrame:
    """Ids missing between consecutive ids of a key."""
    ids = df.select(key, F.col(id).alias("_id")).where("_id is not null").distinct()
    # an id that does not follow another begins a run; runs meet at gaps. No key's ids need to meet in one task.
    begun = ids.join(ids.select(key, (F.col("_id") + 1).alias("_id")), [key, "_id"], "left_anti").groupBy(key).agg((F.count("*") - 1).alias("gaps"))
    span = ids.groupBy(key).agg((F.max("_id") - F.min("_id") + 1 - F.count("*")).alias("missing"))
    return span.join(begun, key)


# top-k and sets
def top_keys(df: DataFrame, col: str, n: int) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), col).limit(n)


def newest(df: DataFrame, ts: str, tie: str, n: int = 100) -> DataFrame:
    """The newest rows with a time; equal times by ``tie``, largest first."""
    return df.where(F.col(ts).isNotNull()).orderBy(F.desc(ts), F.desc(tie)).limit(n)


def head(df: DataFrame, n: int, *order) -> DataFrame:
    """The first rows of an order; without one, any rows."""
    return (df.orderBy(*order) if order else df).limit(n)


def sort_within(df: DataFrame, file: str, ts: str, *tie: str) -> DataFrame:
    """Each file's rows in order of time, files kept apart: rows of a file share a partition, which Spark sorts with spilling."""
    return df.repartition(file).sortWithinPartitions(file, ts, *tie)


def union_all(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def insert_ignore(target: DataFrame, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Target plus the batch's first row of each key that it lacks."""
    first = batch.groupBy(*keys).agg(F.min_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
    return target.unionByName(first.join(target, keys, "left_anti").select(*target.columns))

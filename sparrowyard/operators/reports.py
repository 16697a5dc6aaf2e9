"""Summaries that dashboards and reports show: key figures, quality of alerts, samples, runs and bridges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# joins and keys
def join_where(a: DataFrame, b: DataFrame, on, cond: Column) -> DataFrame:
    """Equality join, then any condition on the pair."""
    return a.join(b, on).where(cond)


def drop_prefix(df: DataFrame, col: str, prefix: str) -> DataFrame:
    """Rows whose value does not begin with the prefix; nulls stay."""
    return df.where(~F.coalesce(F.col(col).startswith(prefix), F.lit(False)))


def remap_ids(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges on ``vertices.id`` instead of ``vertices.ext``; edges with an unknown end are dropped."""
    ends = lambda c: vertices.select(F.col("ext").alias(c), F.col("id").alias(f"{c}_id"))
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.join(ends("src"), "src").join(ends("dst"), "dst").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), *rest)


def normalize_bridge(df: DataFrame, key: str, array_col: str) -> tuple[DataFrame, DataFrame]:
    """Distinct array members with an id from their content, and the bridge from keys to these ids."""
    member = F.sha1(F.col("value").cast("string").cast("binary"))
    rows = df.select(key, F.explode(array_col).alias("value")).where(F.col("value").isNotNull()).withColumn("member_id", F.substring(member, 1, 16))
    return rows.select("member_id", "value").distinct(), rows.select(key, "member_id").distinct()


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def all_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


# aggregates
def basic_stats(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.count(col).alias("n"), F.sum(col).alias("total"), F.avg(col).alias("mean"))


def collect_sorted(df: DataFrame, key: str, value: str) -> DataFrame:
    """Each key with its distinct values in order. The list is the result: its length is the key's distinct values."""
    return df.select(key, value).distinct().groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("members"))


def time_bounds(df: DataFrame, key: str, ts: str) -> DataFrame:
    return df.groupBy(key).agg(F.min(ts).alias("first_at"), F.max(ts).alias("last_at"))


def precision_recall(alerts: DataFrame, accounts: str, truth: DataFrame) -> DataFrame:
    """Flagged accounts (comma-separated lists) against ``truth.account``; an empty side gives 0."""
    flagged = alerts.select(F.explode(F.split(accounts, ",")).alias("a")).select(F.trim("a").alias("account")).where("account <> ''").distinct()
    marks = flagged.withColumn("f", F.lit(1)).join(truth.select("account").where("account is not null").distinct().withColumn("t", F.lit(1)), "account", "full_outer")
    sums = marks.agg(F.count("f").alias("flagged"), F.count("t").alias("truth"), F.count_if(F.col("f").isNotNull() & F.col("t").isNotNull()).alias("hits"))
    share = lambda of: F.coalesce(F.try_divide(F.col("hits"), F.col(of)), F.lit(0.0))
    return sums.select("*", share("flagged").alias("precision"), share("truth").alias("recall"))


def microbatch_summary(batches: DataFrame, run: str = "run") -> DataFrame:
    """Throughput (rows over milliseconds) and mean latency over the micro-batches that had rows."""
    some = batches.where("numInputRows > 0 and triggerExecutionMs is not null")
    sums = some.groupBy(run).agg(F.sum("numInputRows").alias("total_input_rows"), F.count("*").alias("n_nonempty_batches"), F.sum("triggerExecutionMs").alias("ms"), F.avg("triggerExecutionMs").alias("avg"))
    rate = F.coalesce(F.try_divide(F.col("total_input_rows") * 1000.0, F.col("ms")), F.lit(0.0))
    return sums.select(run, "total_input_rows", "n_nonempty_batches", F.round("ms", 1).alias("sum_trigger_ms_nonempty"), F.round(rate, 1).alias("throughput_rps"), F.round("avg", 1).alias("avg_latency_ms"))


def size_summary(labels: DataFrame) -> DataFrame:
    """Communities: their number, and their sizes at indexes 0, ``int(n * p)`` and n - 1 in order.

    The window runs over distinct sizes, of which there are at most ``sqrt(2 * nodes)``.
    """
    sizes = labels.groupBy("label").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("c"))
    w = Window.partitionBy(F.lit(0))
    swept = sizes.select("size", F.sum("c").over(w.orderBy("size")).alias("upto"), F.sum("c").over(w).alias("n"))
    at = lambda p: F.min(F.when(F.col("upto") > F.floor(F.col("n") * p), F.col("size")))
    return swept.agg(F.max("n").alias("communities"), F.min("size").alias("min"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.max("size").alias("max"))


def kpi_latest(df: DataFrame, window: str, category: str, count: str) -> DataFrame:
    """The newest window's extremes, total, leading category (ties to the greater name) with its share, and number of categories."""
    one = latest_window(df, window).groupBy(window, category).agg(F.sum(count).alias("n"))
    lead = F.max_by(category, F.struct("n", category))
    top = one.groupBy(window).agg(F.max("n").alias("most"), F.min("n").alias("least"), F.sum("n").alias("total"), lead.alias("top_category"), F.count("*").alias("categories"))
    return top.withColumn("top_share", F.round(F.col("most") / F.col("total") * 100, 2))


def alert_timeline(df: DataFrame, ts: str, sensor: str, flag: str, minutes: int) -> DataFrame:
    """Whether a sensor raised the flag, per second of the last minutes before the newest row."""
    newest = df.agg(F.max(ts).alias("newest"))
    late = df.join(F.broadcast(newest), F.col(ts) > F.col("newest") - F.make_dt_interval(mins=F.lit(minutes)))
    return late.groupBy(F.date_trunc("second", ts).alias("second"), sensor).agg(F.max(F.col(flag).cast("int")).alias("raised"))


def risk_summary(df: DataFrame, risk: str, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"), F.avg(risk).alias("avg_risk"), F.count_if(F.col(risk) >= 80).alias("critical"))


def tx_summary(tx: DataFrame, kind: str, ms: str, fraud: Column) -> DataFrame:
    return tx.groupBy(kind).agg(F.count("*").alias("n"), F.count_if(fraud).alias("frauds"), F.min(ms).alias("first_ms"), F.max(ms).alias("last_ms"))


# windows
def latest_window(df: DataFrame, window: str) -> DataFrame:
    """Rows of the newest window; the broadcast side is one row."""
    newest = df.agg(F.max(window).alias(window))
    return df.join(F.broadcast(newest), window, "left_semi")


def elapsed(df: DataFrame, key: str, ts: str) -> DataFrame:
    """Seconds since the key's first row: an aggregate joined back, so no key's rows meet in one task."""
    first = df.groupBy(key).agg(F.min(ts).alias("_first"))
    return df.join(first, key).withColumn("elapsed_s", F.unix_micros(F.col(ts).cast("timestamp")) / 1e6 - F.unix_micros(F.col("_first").cast("timestamp")) / 1e6).drop("_first")


def first_last_row(df: DataFrame, order: str) -> DataFrame:
    """First and last row by a unique order, as one row of ``first_*`` and ``last_*``."""
    one = df.agg(F.min_by(F.struct(*df.columns), order).alias("f"), F.max_by(F.struct(*df.columns), order).alias("l"))
    return one.select(*[F.col(f"{s}.{c}").alias(f"{n}_{c}") for s, n in (("f", "first"), ("l", "last")) for c in df.columns])


# Patterns that a text is tried against.
DATE_PATTERNS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd", "MM/dd/yyyy", "dd/MM/yyyy", "MM/dd/yyyy HH:mm:ss", "dd-MM-yyyy")


def date_columns(df: DataFrame, order: str) -> DataFrame:
    """Text columns that hold dates, as ``column, sample``: the first value has a separator and a digit, the first three parse.

    The first values are those by ``order`` that are not null; a column without any holds no dates.
    """
    parts = []
    for c in [c for c, kind in df.dtypes if kind == "string" and c != order]:
        first = df.where(F.col(c).isNotNull()).select(F.col(order).alias("o"), F.col(c).alias("v")).orderBy("o", "v").limit(3)
        parsed = F.coalesce(*[F.try_to_timestamp("v", F.lit(p)) for p in DATE_PATTERNS]).isNotNull()
        one = first.agg(F.min_by("v", F.struct("o", "v")).alias("sample"), F.bool_and(parsed).alias("ok"))
        parts.append(one.where("ok").where(F.col("sample").rlike("[-/ ]") & F.col("sample").rlike("[0-9]")).select(F.lit(c).alias("column"), "sample"))
    return reduce(DataFrame.union, parts) if parts else df.sparkSession.createDataFrame([], "column string, sample string")


def with_lineage(df: DataFrame) -> DataFrame:
    """Rows of a file source with their file and the time of the query."""
    return df.select("*", F.col("_metadata.file_path").alias("source_file"), F.current_timestamp().alias("loaded_at"))


# copies and samples
def amplify(df: DataFrame, factor: int, id_cols: list[str]) -> DataFrame:
    """``factor`` copies of each row; ids of all but the first copy end in ``#`` and the copy's number."""
    if factor < 1:
        raise ValueError("factor must be 1 or more")
    copies = df.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))))
    named = lambda c: F.when((F.col("shard") == 0) | F.col(c).isNull() | (F.col(c).cast("string") == ""), F.col(c).cast("string")).otherwise(F.concat(F.col(c).cast("string"), F.lit("#"), F.col("shard")))
    return copies.select(*[named(c).alias(c) if c in id_cols else F.col(c) for c in df.columns], "shard")


def rare_sample(df: DataFrame, idx: str, head: int, scan: int, rare: Column) -> DataFrame:
    """The first rows, and the rare ones up to the scan's end."""
    return df.where((F.col(idx) < head) | ((F.col(idx) < scan) & rare))


# vectors
def nearest_category(df: DataFrame, vec: str, categories: DataFrame, limit: int = 10_000) -> DataFrame:
    """``category`` and ``confidence`` by the greatest cosine with ``categories(name, vec)``, ties to the smaller name.

    The categories become literals of the plan; more than ``limit`` of them are refused. A null or zero vector
    has null in both columns.
    """
    found = categories.select("name", F.col("vec").cast("array<double>")).limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"more than {limit} categories")
    cells = []
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(F.col(vec), F.col(vec)))
    for name, v in sorted(map(tuple, found)):
        size = sum(x * x for x in v) ** 0.5
        if size:
            cells.append(F.struct(F.lit(name).alias("name"), F.lit([x / size for x in v]).alias("unit")))
    if not cells:
        return df.withColumns({"category": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double")})
    scored = F.transform(F.array(*cells), lambda c: F.struct(F.try_divide(dot(F.col(vec), c["unit"]), norm).alias("cos"), c["name"].alias("name")))
    best = F.array_max(F.transform(scored, lambda s: s["cos"]))
    lead = F.get(F.filter(scored, lambda s: s["cos"] == best), F.lit(0))
    return df.withColumn("_best", lead).withColumns({"category": F.col("_best.name"), "confidence": F.col("_best.cos")}).drop("_best")


def category_vectors(df: DataFrame, vec: str, label: str) -> DataFrame:
    """Mean vector of each label, added up by position with partial aggregation."""
    cells = df.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("name"), F.posexplode(vec).alias("pos", "x"))
    means = cells.groupBy("name", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vec"))

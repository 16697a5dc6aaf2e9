"""Text logs of runs as ``lines(file, value)``: one row of metrics a file, and statistics by level and class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowyard.functions.columns import near

# The log layout.
ARGS = r"args is set to '.*?/([^/ ]+)\s+(\d+)\s+(\d+)\s+(?:-?\d+)\s+(\d+)\s+([a-zA-Z0-9_]+)\s+([a-zA-Z0-9_]+)"
THREADS = r"--executor-cores\s+(\d+)"
STAMP = r"^(\d{2}/\d{2}/\d{2} \d{2}:\d{2}:\d{2})"
STEP = r"^(\d{2}/\d{2}/\d{2} \d{2}:\d{2}:\d{2})\s+\S+\s+\d+\s+(\d+)\s+(\d+).*\s([0-9.]+)$"
LEVEL = r"^(\d{2}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}) (\w+) ([^: ]+):"
ELAPSED = r"ElapsedTimeMs=(\d+)"
BEST_COST = r"BestSubgraph=.*cost=([0-9.]+)"
BEST_VERTICES = r"BestSubgraph=.*nvertices=(\d+)"
BEST_EDGES = r"BestSubgraph=.*nedges=(\d+)"
RUN = r"SubgraphOptimization\s+(\d+)"


def lines_like(lines: DataFrame, pattern: str) -> DataFrame:
    return lines.where(F.col("value").like(pattern))


def lines_match(lines: DataFrame, regex: str) -> DataFrame:
    return lines.where(F.col("value").rlike(regex))


def _part(regex: str, group: int, kind: str) -> Column:
    return F.regexp_extract("value", regex, group).try_cast(kind)


#: Metrics of a best line: name, pattern and type. ``effective_runs`` counts from 0 in the logs.
BEST = (
    ("total_time_ms", ELAPSED, "int"), ("cost_best_solution", BEST_COST, "double"), ("vertices_best_solution", BEST_VERTICES, "int"),
    ("edges_best_solution", BEST_EDGES, "int"), ("effective_runs", RUN, "int"),
)
#: Parameters of a run: name and type, in the order of the groups of ``ARGS``.
PARAMETERS = (("graph_name", "string"), ("initial_vertices", "int"), ("num_initial_solutions", "int"), ("timeout_ms", "int"), ("objective_function", "string"), ("metaheuristic", "string"))


def parsed(lines: DataFrame) -> DataFrame:
    """Each line that says something, read once: ``file``, and one of ``args``, ``threads``, ``best``, ``state`` (a struct, null in other lines).

    A plain substring is looked for before a pattern is tried, and other lines are dropped here.
    """
    v = F.col("value")
    is_args, is_threads, is_best = v.contains("args is set to '"), v.contains("--executor-cores"), v.contains("BestSubgraph=")
    args = F.struct(*[_part(ARGS, i, kind).alias(n) for i, (n, kind) in enumerate(PARAMETERS, 1)])
    best = F.struct(*[_part(p, 1, kind).alias(n) for n, p, kind in BEST], v.alias("best_solution"))
    at = F.try_to_timestamp(F.regexp_extract("value", STAMP, 1), F.lit("yy/MM/dd HH:mm:ss"))
    state = F.struct(at.alias("at"), _part(STEP, 2, "int").alias("v"), _part(STEP, 3, "int").alias("e"), _part(STEP, 4, "double").alias("cost"))
    rows = lines.select("file", F.when(is_args, args).alias("args"), F.when(is_threads, F.struct(_part(THREADS, 1, "int").alias("n"))).alias("threads"), F.when(is_best, best).alias("best"), F.when(v.rlike(STEP), state).alias("state"))
    return rows.where("args is not null or threads is not null or best is not null or state.cost is not null")


def _metrics(lines: DataFrame) -> DataFrame:
    """One row a file: ``args`` and ``threads`` (lists, as long as the file has such lines), the best row and ``time_to_best_solution_ms``.

    States are reduced to their first time per file and value by partial aggregation; the file's best then meets
    those few rows in a window.
    """
    state = [F.col(f"state.{c}").alias(c) for c in ("v", "e", "cost")]
    names = [n for n, *_ in BEST] + ["best_solution"]
    values = parsed(lines).groupBy("file", *state).agg(
        F.min("state.at").alias("at"), F.collect_list("args").alias("args"), F.collect_list("threads.n").alias("threads"), F.count("threads").alias("n_threads"),
        *[F.max(f"best.{n}").alias(n) for n in names],
    )
    w = Window.partitionBy("file")
    swept = values.select("file", "v", "e", "cost", "at", "args", "threads", "n_threads", *[F.max(n).over(w).alias(n) for n in names])
    same = (F.col("v") == F.col("vertices_best_solution")) & (F.col("e") == F.col("edges_best_solution")) & near(F.col("cost"), F.col("cost_best_solution"))
    one = swept.groupBy("file").agg(
        F.flatten(F.collect_list("args")).alias("args"), F.flatten(F.collect_list("threads")).alias("threads"), F.sum("n_threads").alias("n_threads"), *[F.first(n).alias(n) for n in names],
        F.min(F.when(F.col("cost").isNotNull(), F.col("at"))).alias("began"), F.min(F.when(same, F.col("at"))).alias("hit"),
    )
    runs = (F.col("effective_runs") + 1).alias("effective_runs")
    took = ((F.unix_timestamp("hit") - F.unix_timestamp("began")) * 1000).alias("time_to_best_solution_ms")
    return one.select("file", "args", "threads", "n_threads", *[runs if n == "effective_runs" else F.col(n) for n in names], "began", took)


def run_parameters(lines: DataFrame) -> DataFrame:
    """Input, sizes and time limit of a run; a file with several such lines has several rows."""
    return parsed(lines).where("args is not null").select("file", "args.*")


def best_per_file(lines: DataFrame) -> DataFrame:
    """Each column's own maximum a file, so ``best_solution`` is the greatest line as text, whatever its cost."""
    names = [n for n, *_ in BEST] + ["best_solution"]
    best = parsed(lines).where("best is not null").groupBy("file").agg(*[F.max(f"best.{n}").alias(n) for n in names])
    return best.withColumn("effective_runs", F.col("effective_runs") + 1)


def timeline(lines: DataFrame) -> DataFrame:
    """Time, vertices, edges and cost of each intermediate state."""
    return parsed(lines).where("state.cost is not null").select("file", "state.*")


def time_to_best(lines: DataFrame) -> DataFrame:
    """Milliseconds from a file's first state to the first one that equals its best; null where none does. Files with states only."""
    return _metrics(lines).where("began is not null").select("file", "time_to_best_solution_ms")


def log_etl(lines: DataFrame) -> DataFrame:
    """One row of metrics for each run line of a file, times its lines of threads; the lines are read once."""
    m = _metrics(lines)
    named = [n for n, *_ in BEST] + ["best_solution", "time_to_best_solution_ms"]
    rows = m.select("file", F.inline("args"), "threads", "n_threads", *named)
    # a thread line whose number cannot be read counts as one without a number
    threads = F.when(F.col("n_threads") > F.size("threads"), F.concat("threads", F.array_repeat(F.lit(None).cast("int"), (F.col("n_threads") - F.size("threads")).cast("int")))).otherwise(F.col("threads"))
    return rows.select("file", *[n for n, _ in PARAMETERS], F.explode_outer(threads).alias("num_threads"), *named)


def log_level_stats(lines: DataFrame) -> DataFrame:
    """Lines and characters per level and class."""
    rows = lines_match(lines, LEVEL).select(F.lower(F.regexp_extract("value", LEVEL, 2)).alias("level"), F.regexp_extract("value", LEVEL, 3).alias("class"), F.length("value").alias("n"))
    return rows.groupBy("level", "class").agg(F.count("*").alias("lines"), F.sum("n").alias("chars"))


def file_stats(lines: DataFrame, sep: str = ",") -> DataFrame:
    """Rows, columns of the widest row, and distinct values of the first column, per file."""
    parts = F.split("value", sep, -1)
    return lines.groupBy("file").agg(F.count("*").alias("n_rows"), F.max(F.size(parts)).alias("n_columns"), F.countDistinct(F.get(parts, F.lit(0))).alias("distinct_first"))

"""Chat formatting: a hidden Markov model recovers speaker roles from transcripts, then turns are rendered.

States are (role, first line of a turn | later line). A line is observed as one symbol: its speaker marker's
class (none where there is no marker), whether it ends in a question mark, its length class, and whether it
looks like code or a list, and whether it is the first of its row. Start, transition and symbol probabilities are smoothed counts over ALL labelled
lines, aggregated in Spark into a table of states x symbols; markers are masked in a share of the counts, so
that missing markers are no surprise.

Viterbi is exact for conversations of any length: lines are range-partitioned in order of conversation, turn and
line, and a conversation's lines in one range are a block, so neither a long turn nor a third of all rows in one
conversation (or none) is one task's. A block's effect is a states x states table of best scores, the tables of a
conversation are chained in order, and each block is then decoded between the states that the chain chose.

Defined results: null texts are one empty line; a null role is no marker; null turns come first; rows of turns
with equal numbers keep the order of their texts, repeated rows follow each other; a null conversation id is a
conversation of its own; other columns are ignored; empty tables stay empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowyard.llm.common import written

ROLES = ("user", "assistant", "system", "tool")
#: Speaker names as transcripts write them.
NAMES = {
    "user": ("user", "human", "customer", "q", "question", "prompter", "me"),
    "assistant": ("assistant", "ai", "bot", "gpt", "agent", "a", "answer", "model", "chatbot"),
    "system": ("system", "instruction", "context"),
    "tool": ("tool", "function", "observation", "output"),
}
MARKER = r"^\s*(?:<\|)?[\[(*#]*\s*([A-Za-z]{1,12})\s*[\])*]*\s*(?:\|>|:)\s?"
N_SYMBOLS = 5 * 2 * 4 * 2


def marker_class(name: Column) -> Column:
    """0 for no speaker, else 1 + the role's number."""
    low, out = F.lower(F.trim(name)), F.lit(0)
    for i, role in enumerate(ROLES):
        out = F.when(low.isin(*NAMES[role]), i + 1).otherwise(out)
    return F.coalesce(out, F.lit(0))


def lines_of(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text", keep: str | None = None) -> DataFrame:
    """Lines of transcript rows: ``conv, turn, tie, line, text`` (marker cut off) and ``symbol``, with column ``keep`` of the row."""
    kept = [F.col(keep)] if keep else []
    rows = turns.select(F.col(conv).cast("string").alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(text), F.lit("")).alias("t"), *kept)
    rows = rows.select("conv", "turn", F.xxhash64("t").alias("tie"), *kept, F.posexplode(F.split("t", "\n")).alias("line", "raw"))
    mark = marker_class(F.regexp_extract("raw", MARKER, 1))
    body = F.when(mark > 0, F.regexp_replace("raw", MARKER, "")).otherwise(F.col("raw"))
    rows = rows.select("conv", "turn", "tie", "line", *kept, mark.alias("mark"), body.alias("text"))
    size = F.length("text")
    length = F.when(size == 0, 0).when(size < 40, 1).when(size < 160, 2).otherwise(3)
    code = F.col("text").rlike(r"^(?:\s{4}|\t|```|[-*] |[0-9]+[.)] )").cast("int")
    asks = F.col("text").rlike(r"\?\s*$").cast("int")
    return rows.withColumn("symbol", ((((F.col("mark") * 2 + asks) * 4 + length) * 2 + code) * 2 + (F.col("line") == 0).cast("int")).cast("int")).drop("mark")


@dataclass
class RoleModel:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @property
    def states(self) -> int:
        return len(self.start)


def fit(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", masked: float = 0.2) -> RoleModel:
    """Counts over all rows whose role is known. Their markers are their roles' names; ``masked`` of each count goes to the line without."""
    rank = marker_class(F.col(role))
    known = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), rank.alias("k"), F.col(text).alias("text")).where("k > 0")
    marked = known.withColumn("text", F.concat(F.element_at(F.array(*map(F.lit, ROLES)), F.col("k")), F.lit(": "), F.coalesce("text", F.lit(""))))
    lines = lines_of(marked, keep="k")
    state = (F.col("k") - 1) * 2 + F.when(F.col("line") > 0, 1).otherwise(0)
    seen = lines.groupBy(state.alias("state"), "symbol").count().collect()  # at most states x symbols rows
    n = 2 * len(ROLES)
    shape, place = np.full((n, N_SYMBOLS), 0.01), np.full((n, 2), 1.0)
    for s, symbol, count in seen:
        look = symbol // 2
        shape[s, look] += count * (1 - masked)
        shape[s, look % 16] += count * masked  # the same line without its marker
        place[s, symbol % 2] += count
    # a row may hold several turns, so its first line is evidence of a new turn, not proof
    shape, place = shape / shape.sum(1, keepdims=True), np.clip(place / place.sum(1, keepdims=True), 0.05, 0.95)
    emit = (shape[:, :, None] * place[:, None, :]).reshape(n, -1)
    # rows of a turn are counted first, so repeated rows are no pairs of rows
    counted = known.groupBy("conv_id", "turn", "k").agg(F.count("*").alias("n"))
    follows = counted.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("k").alias("before"), F.col("n").alias("m"))
    both = counted.join(follows, ["conv_id", "turn"]).groupBy("before", "k").agg(F.sum(F.col("n").cast("double") * F.col("m")))
    pairs = both.collect()  # roles x roles
    first = known.groupBy("conv_id").agg(F.min_by("k", "turn").alias("k")).groupBy("k").count().collect()
    inside = sum(c for s, _, c in seen if s % 2) / max(1, sum(c for _, _, c in seen))
    stay = min(0.98, max(0.02, inside))
    turn_to = np.full((len(ROLES), len(ROLES)), 0.05)
    for a, b, c in pairs:
        turn_to[a - 1, b - 1] += c
    begin = np.full(len(ROLES), 0.05)
    for k, c in first:
        begin[k - 1] += c
    move, start = np.full((n, n), 1e-9), np.full(n, 1e-9)
    for a in range(len(ROLES)):
        start[2 * a] = begin[a] / begin.sum()
        for half in (0, 1):
            move[2 * a + half, 2 * a + 1] = stay
            move[2 * a + half, ::2] = (1 - stay) * turn_to[a] / turn_to[a].sum()
    return RoleModel(np.log(start), np.log(move), np.log(emit))


def _forward(model: RoleModel, symbols: np.ndarray, into: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores after the block for each row of ``into`` (scores before its first line's move), and back pointers."""
    score, back = into, np.zeros((len(symbols), *into.shape), np.int8)
    for i, s in enumerate(symbols.tolist()):
        step = score[:, :, None] + model.move[None]
        back[i] = step.argmax(1)
        score = step.max(1) + model.emit[:, s]
    return score, back


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Consecutive rows with equal first ``keys`` columns."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        ids = list(zip(*[t.column(i).to_pylist() for i in range(keys)], strict=True))
        a = 0
        for i, x in enumerate(ids):
            if x != last:
                if i > a:
                    held.append(t.slice(a, i - a))
                if held:
                    yield pa.concat_tables(held)
                held, last, a = [], x, i
        held.append(t.slice(a))
    if held:
        yield pa.concat_tables(held)


def best_path(model: RoleModel, symbols: np.ndarray) -> list[int]:
    """States of one sequence held whole."""
    score, back = _forward(model, symbols[1:], (model.start + model.emit[:, symbols[0]])[None])
    path = [int(score[0].argmax())]
    for b in back[::-1]:
        path.append(int(b[0, path[-1]]))
    return path[::-1]


def blocks_of(lines: DataFrame, rows: int = 20_000) -> DataFrame:
    """The lines with ``block``, which ascends along a conversation's order; a block has about this many lines at most."""
    n = max(1, -(-lines.count() // rows))
    ranged = lines.repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in ORDER]).withColumn("block", F.spark_partition_id().cast("long"))
    return written(ranged, "lines")


#: The order of lines.
ORDER = ("conv", "turn", "tie", "line")


def roles_of(lines: DataFrame, model: RoleModel, block_rows: int = 20_000) -> DataFrame:
    """``lines`` as turns: ``conv_id, turn, part, role, n_lines, continues, text``; a row of the input may hold several.

    ``part`` is the line of the row at which the turn begins; ``continues``: its role began in lines before it.
    """
    lines = blocks_of(lines, block_rows)
    n = model.states
    whole = np.where(np.eye(n, dtype=bool), 0.0, -1e18)

    def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _grouped(batches, 2):
            score, _ = _forward(model, g.column("symbol").to_numpy(), whole)
            yield pa.RecordBatch.from_arrays([g.column("conv").slice(0, 1).combine_chunks(), g.column("block").slice(0, 1).combine_chunks(), pa.array([score.ravel().tolist()])], ["conv", "block", "effect"])

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _grouped(batches, 1):
            tables = g.column("effect").combine_chunks().flatten().to_numpy().reshape(-1, n, n)
            score, back = None, []
            for t in tables:
                # before the first block stands a virtual line whose move gives the start probabilities
                step = (model.start - 0.0)[:, None] * 0 + t if score is None else score[:, None] + t
                back.append(step.argmax(0))
                score = step.max(0)
            ends = [int(score.argmax())]
            for b in reversed(back):
                ends.append(int(b[ends[-1]]))
            ends = ends[::-1]
            yield pa.RecordBatch.from_arrays([g.column("conv").combine_chunks(), g.column("block").combine_chunks(), pa.array(ends[:-1], pa.int32()), pa.array(ends[1:], pa.int32())], ["conv", "block", "into", "out"])

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _grouped(batches, 2):
            symbols, into, out = g.column("symbol").to_numpy(), g.column("into")[0].as_py(), g.column("out")[0].as_py()
            _, back = _forward(model, symbols, whole[into][None])
            path = [out]
            for b in back[:0:-1]:
                path.append(int(b[0, path[-1]]))
            path = path[::-1]
            turns, at, texts = (g.column(c).to_pylist() for c in ("turn", "line", "text"))
            rows = []
            for i, s in enumerate(path):
                if i == 0 or at[i] == 0 or s % 2 == 0:
                    rows.append([turns[i], at[i], ROLES[s // 2], s % 2 == 1, []])
                rows[-1][4].append(texts[i])
            conv = g.column("conv")[0].as_py()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([conv] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows]),
                    pa.array([len(r[4]) for r in rows], pa.int64()), pa.array([r[3] for r in rows]), pa.array(["\n".join(r[4]) for r in rows]),
                ],
                ["conv_id", "turn", "part", "role", "n_lines", "continues", "text"],
            )

    order = ["conv", "block", *ORDER[1:]]
    symbols = lines.select(*order, "symbol").repartition("conv", "block").sortWithinPartitions(*order).select("conv", "block", "symbol")
    tables = symbols.mapInArrow(effects, "conv string, block long, effect array<double>")
    ends = tables.repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(chained, "conv string, block long, into int, out int")
    ends = ends.select(F.col("conv").alias("c"), F.col("block").alias("b"), "into", "out")
    joined = lines.join(ends, F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).select(*order, "symbol", "text", "into", "out")
    dealt = joined.repartition("conv", "block").sortWithinPartitions(*order).select("conv", "block", "turn", "line", "symbol", "text", "into", "out")
    return dealt.mapInArrow(decoded, "conv_id string, turn long, part int, role string, n_lines long, continues boolean, text string")


def rendered(turns: DataFrame) -> DataFrame:
    """Canonical form of each turn: a role header, the text without outer white space, an end mark."""
    head = F.when(F.col("continues"), F.lit("")).otherwise(F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n")))
    return turns.withColumn("rendered", F.concat(head, F.trim("text"), F.lit("\n<|end|>\n")))

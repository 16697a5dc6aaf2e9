"""Connected components of links by alternating large and small stars, a written table after each round.

Rounds end when the links are stars. ``contracted`` links need fewer rounds, and ``joined`` adds links to components that are known.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowyard.llm.common import written


class NotConverged(RuntimeError):
    """The stars still changed in the last round, so links would be missing."""


def _to_least(pairs: DataFrame, larger_only: bool) -> DataFrame:
    """Each node ``u`` of ``pairs`` (u, v) hands its least neighbour, or itself, to its neighbours.

    The least is found by an aggregation with partial sums and joined back, so a node with very many
    neighbours is never gathered in one place.
    """
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = pairs.join(least, "u")
    if larger_only:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node that links connect to a lesser one, and the least that they connect it to."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, up = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while (apart := (up[a] != up[b])).any():
        a, b = a[apart], b[apart]
        x, y = up[a], up[b]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (up[up] != up).any():
            up = up[up]
    below = up < np.arange(len(nodes))
    return nodes[below], nodes[up[below]]


def contracted(links: DataFrame, rows: int, at_once: int = 1 << 18) -> DataFrame:
    """Links ``u, v`` that connect what these do: stars within a task's rows, without a shuffle. A task has about ``at_once`` of the ``rows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def stars() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            held.clear()
            return pa.RecordBatch.from_arrays(list(map(pa.array, _forest(rows["u"].to_numpy(), rows["v"].to_numpy()))), ["u", "v"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= at_once:
                yield stars()
        if held:
            yield stars()

    return links.select("u", "v").coalesce(max(1, -(-rows // at_once))).mapInArrow(run, "u long, v long")


def _stars(links: DataFrame) -> bool:
    """Whether every node has either one link, to its lesser end, or links to greater ones alone."""
    ends = links.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where(F.col("up") + F.col("down") > 1).agg(F.count("*")).first()[0] == 0


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``links`` has long columns ``u``, ``v``; the result has every linked node ``u`` and ``root``, the least node it reaches.

    Loops and repeated links are harmless; no links give no rows. The driver sees one count a round.
    """
    links = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    for done in range(rounds + 1):
        if _stars(links):
            break
        if done == rounds:
            raise NotConverged(f"components are not whole after {rounds} rounds")
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both, True).where("u <> v").distinct()
        small = _to_least(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), False).where("u <> v").distinct()
        links = written(small, "links")
    # every node now points straight at its root
    return links.select("u", F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())


def joined(roots: DataFrame, links: DataFrame, rows: int) -> DataFrame:
    """``u, root`` as ``components`` would give them for these links (``rows`` of them) and those that ``roots`` came from; only what the links join is gone through."""
    of = lambda side: roots.select(F.col("u").alias(side), F.col("root").alias(f"{side}_root"))
    between = links.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("u_root", "u").alias("u"), F.coalesce("v_root", "v").alias("v"))
    new = components(contracted(between.where("u <> v"), rows))
    moved = roots.join(new.select(F.col("u").alias("root"), F.col("root").alias("to")), "root", "left").select("u", F.coalesce("to", "root").alias("root"))
    return moved.unionByName(new.join(roots, "u", "left_anti"))

"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

* Fit: a bounded sample (``sample_rows`` rows with the smallest hash of their id, 20,000 by default) is split
  by k-means into ``branches`` parts, and each part again, until a part has ``leaf_rows`` sample rows or fewer.
* Index: every row descends to its leaf. The tree (at most two nodes per sample row) is shipped with the tasks.
* Search: each query walks the tree with a priority queue and so lists leaves from best to worst. A leaf's
  priority is the query's inner product with its centre, plus twice the leaf's spread along one direction; a node's
  is that of the best leaf below it. A query visits as many leaves as calibration asks for, and more until they
  hold enough rows.
* Calibration: ``probes`` queries (bounded) are compared with ALL rows by brute force in blocks; the number of
  visits is widened until their mean recall reaches ``recall``.

Rows and queries of a leaf meet in chunks of bounded size (leaf, row chunk, query block), so a leaf with a
third of all rows is many tasks, and each chunk hands on its best k per query only. Blocks are made of queries whose
best leaves are neighbours in the tree, and a row goes only to the blocks that visit its leaf. Scores are sums over
the components in order, in double precision, so equal vectors tie exactly.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part; repeated
rows are candidates of their own but never of a query with their id; a query id that is repeated is asked once,
with the vector that is smallest in order; other columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from sparrowyard.llm.common import written


@dataclass
class Tree:
    """Node i has centre ``centres[i]`` and children ``kids[i]``; a node without children is a leaf."""

    centres: np.ndarray
    kids: list[list[int]]
    spread: np.ndarray

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row: the nearest child at every level."""
        at = np.zeros(len(x), np.int64)
        active = np.arange(len(x))
        while len(active):
            moving = []
            for node in np.unique(at[active]):
                rows = active[at[active] == node]
                if self.kids[node]:
                    c = self.centres[self.kids[node]]
                    at[rows] = np.array(self.kids[node])[((c**2).sum(1) - 2 * x[rows] @ c.T).argmin(1)]
                    moving.append(rows)
            active = np.concatenate(moving) if moving else np.zeros(0, np.int64)
        return at

    def best_first(self, q: np.ndarray) -> Iterator[int]:
        """Leaves by best-bin-first traversal."""
        worth = self.centres @ q + 2 * self.spread * np.sqrt(q @ q)
        for node in range(len(self.kids) - 1, -1, -1):  # children come after their parents
            if self.kids[node]:
                worth[node] = max(worth[k] for k in self.kids[node])
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if not self.kids[node]:
                yield node
            for kid in self.kids[node]:
                heapq.heappush(queue, (-float(worth[kid]), kid))

    def in_order(self) -> list[int]:
        """Leaves in depth-first order, so that neighbours in the list are neighbours in the tree."""
        out, todo = [], [0]
        while todo:
            node = todo.pop()
            out += [] if self.kids[node] else [node]
            todo += self.kids[node][::-1]
        return out


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Part of each row."""
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        part = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
        c = np.stack([x[part == j].mean(0) if (part == j).any() else c[j] for j in range(k)])
    return ((c**2).sum(1) - 2 * x @ c.T).argmin(1)


def grow_tree(x: np.ndarray, branches: int, leaf_rows: int, seed: int = 7) -> Tree:
    rng, centres, kids, todo = np.random.default_rng(seed), [x.mean(0) if len(x) else np.zeros(x.shape[1])], [[]], [(0, np.arange(len(x)))]
    wide = lambda rows, c: float(np.sqrt(((x[rows] - c) ** 2).mean())) if len(rows) else 0.0
    spread = [wide(np.arange(len(x)), centres[0])]
    while todo:
        node, rows = todo.pop()
        if len(rows) <= leaf_rows:
            continue
        part = _k_means(x[rows], min(branches, len(rows)), rng)
        groups = [rows[part == j] for j in np.unique(part)]
        if len(groups) < 2:  # copies of one vector cannot be split
            continue
        for g in groups:
            kids[node].append(len(centres))
            todo.append((len(centres), g))
            centres.append(x[g].mean(0))
            spread.append(wide(g, centres[-1]))
            kids.append([])
    return Tree(np.array(centres), kids, np.array(spread))


def _matrix(column) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return a.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(a), -1) if len(a) else np.zeros((0, 0))


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products, components added in order."""
    out = np.zeros((len(q), len(x)))
    for j in range(q.shape[1]):
        out += q[:, j, None] * x[None, :, j]
    return out


def _best(qid: np.ndarray, q: np.ndarray, vid: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row and score of the k best rows of each query, ties to the smaller id."""
    out: list = [[], [], []]
    order = np.argsort(vid, kind="stable")
    vid, x = vid[order], x[order]
    for a in range(0, len(q), 64):
        s = scores(q[a : a + 64], x)
        s[qid[a : a + 64, None] == vid[None, :]] = -np.inf
        top = np.argsort(-s, axis=1, kind="stable")[:, :k]
        for i, t in enumerate(top):
            t = t[s[i, t] > -np.inf]
            out[0].append(np.full(len(t), qid[a + i]))
            out[1].append(vid[t])
            out[2].append(s[i, t])
    return tuple(np.concatenate(o) if o else np.zeros(0) for o in out)


def usable(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id`` and ``v`` (doubles) of the vectors that take part."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.where(F.col(id).isNotNull() & F.col(vector).isNotNull()).select(F.col(id).cast("long").alias("id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite & F.exists("v", lambda x: x != 0))


def _calibrated(rows: DataFrame, queries: DataFrame, tree: Tree, k: int, probes: int, recall: float) -> int:
    """Leaf visits that give the probes their recall, judged against all rows."""
    probe = queries.orderBy(F.xxhash64("id", F.lit("probe")), "id").limit(probes).toPandas()
    if not len(probe):
        return 1
    qid, q = probe["id"].to_numpy(), np.stack(probe["v"].to_list()).astype(np.float64)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b, s = _best(qid, q, batch.column(0).to_numpy(), _matrix(batch.column(1)), k)
                x = dict(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a.astype("i8")), pa.array(b.astype("i8")), pa.array(s), pa.array([x[i] for i in b.tolist()], pa.int64())], ["q", "id", "score", "leaf"])

    found = rows.select("id", "v", "leaf").mapInArrow(nearest, "q long, id long, score double, leaf long")
    top = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    truth = top.toPandas()  # probes x k rows
    ranks = []
    for i, one in truth.groupby("q"):
        order = {leaf: n for n, leaf in enumerate(tree.best_first(q[qid == i][0]), 1)}
        ranks += [order[x] for x in one["leaf"]]
    return int(np.sort(ranks)[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]) if ranks else 1


def search(
    vectors: DataFrame, queries: DataFrame, id: str = "vec_id", vector: str = "embedding", k: int = 20, recall: float = 0.93,
    sample_rows: int = 20_000, branches: int = 8, leaf_rows: int = 120, probes: int = 200, chunk: int = 4_000, block: int = 20_000, report: dict | None = None,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows with the largest inner product found for each query, but for its own id.

    ``report`` receives the number of leaves, the visits and the mean share of all rows that a query's leaves hold.
    """
    spark = vectors.sparkSession
    rows, asked = usable(vectors, id, vector), usable(queries, id, vector).groupBy("id").agg(F.min("v").alias("v"))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).toPandas()
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tree = grow_tree(np.stack(sample["v"].to_list()).astype(np.float64), branches, leaf_rows)

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tree.leaves_of(_matrix(batch.column(1))))], ["id", "v", "leaf"])

    index = written(rows.mapInArrow(descend, "id long, v array<double>, leaf long"), "leaves")
    visits = _calibrated(index, asked, tree, k, probes, recall)
    held = {r["leaf"]: r["count"] for r in index.groupBy("leaf").count().collect()}  # a row per leaf of the bounded tree
    parts = {leaf: -(-n // chunk) for leaf, n in held.items()}

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                at, home, leaf, piece, first = [], [], [], [], []
                for i, q in enumerate(_matrix(part.column(1))):
                    seen = 0
                    for n, x in enumerate(tree.best_first(q)):
                        if n == 0:
                            best = x
                        if n >= visits and seen > k:
                            break
                        for c in range(parts.get(x, 0)):
                            at.append(i)
                            home.append(best)
                            leaf.append(x)
                            piece.append(c)
                            first.append(seen <= 100 * k)
                        seen += held.get(x, 0)
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(home, pa.int64()), pa.array(leaf, pa.int64()), pa.array(piece, pa.int32()), pa.array(first, pa.bool_())], ["qid", "q", "home", "leaf", "piece", "first"])

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"q": [], "id": [], "score": []})
        a, b, s = _best(left["qid"].to_numpy(), np.stack(left["q"].to_list()), right["id"].to_numpy(), np.stack(right["v"].to_list()), k)
        bound = dict(zip(left["qid"].to_list(), left["least"].to_list(), strict=True))
        good = s >= np.array([bound[i] for i in a.tolist()], float) if len(a) else np.zeros(0, bool)
        return pd.DataFrame({"q": a[good].astype("i8"), "id": b[good].astype("i8"), "score": s[good]})

    walked = written(asked.mapInArrow(visit, "qid long, q array<double>, home long, leaf long, piece int, first boolean"), "visits")
    if report is not None:
        n_of = F.create_map(*[F.lit(int(z)) for pair in held.items() for z in pair])
        seen = walked.where("piece = 0").groupBy("qid").agg(F.sum(n_of[F.col("leaf").cast("int")]).alias("n")).agg(F.avg("n")).first()[0]
        report |= {"leaves": len(held), "visits": visits, "share": (seen or 0) / sum(held.values())}
    # queries whose best leaves are neighbours make a block, so neither side of a group grows with the input
    at_home = {r.home: r.n for r in walked.groupBy("home").agg(F.count_distinct("qid").alias("n")).collect()}  # a row per leaf at most
    cuts, full, last = {}, 0, 0
    for leaf in tree.in_order():
        n = at_home.get(leaf, 0)
        if n and full + n > block and full:
            full, last = 0, last + 1
        cuts[leaf] = (last, max(1, -(-n // block)))
        full, last = (full + n, last) if n <= block else (0, last + cuts[leaf][1])
    first_of, many = (F.create_map(*[F.lit(int(z)) for leaf, c in cuts.items() for z in (leaf, c[k])])[F.col("home").cast("int")] for k in (0, 1))
    wanted = walked.withColumn("block", (first_of + F.pmod(F.xxhash64("qid"), many)).cast("int"))
    n_parts = F.create_map(*[F.lit(int(z)) for pair in parts.items() for z in pair])
    pieces = index.withColumn("piece", F.pmod(F.xxhash64("id"), n_parts[F.col("leaf").cast("int")]).cast("int"))
    visited = wanted.groupBy("leaf", "piece", "block").count().select(F.col("leaf").alias("l"), F.col("piece").alias("p"), F.col("block").alias("b"))
    pieces = pieces.join(visited, (F.col("leaf") == F.col("l")) & (F.col("piece") == F.col("p"))).select("id", "v", F.col("l").alias("leaf"), F.col("p").alias("piece"), F.col("b").alias("block"))
    keys, columns = ["leaf", "piece", "block"], ["qid", "q", "leaf", "piece", "block", "least"]

    def met(who: DataFrame) -> DataFrame:
        return who.select(*columns).groupBy(*keys).cogroup(pieces.groupBy(*keys)).applyInPandas(nearest, "q long, id long, score double")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)

    # the best bins first: their k-th score is what rows of later bins have to reach
    lowest = F.lit(float("-inf"))
    start = written(best(met(wanted.where("first").withColumn("least", lowest))), "nearest")
    least = start.groupBy(F.col("q").alias("qid")).agg(F.when(F.count("*") >= k, F.min("score")).otherwise(lowest).alias("least"))
    later = wanted.where("not first").join(least, "qid", "left").withColumn("least", F.coalesce("least", lowest))
    ranked = best(start.select("q", "id", "score").unionByName(met(later)))
    return ranked.select(F.col("q").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")

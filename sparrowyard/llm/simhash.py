"""SimHash near-duplicates by pivot distance tables.

A pivot table holds each fingerprint's Hamming distances to reference fingerprints. Two fingerprints at
distance d differ by d at most in every coordinate, so a pair with a larger difference is discarded.

Random references alone cannot find the pairs: distances of unrelated fingerprints crowd around 32 +- 4, and
over half of all pairs survive each coordinate. So there are two sets of references. The first set has, for
each of seven blocks of bits, the empty fingerprint and one fingerprint per bit of the block; equal distances
to the references of a block mean equal bits in it, so a block's coordinates are kept as the block's bits.
Fingerprints at 4 or fewer differing bits agree in all coordinates of at least three blocks (4 bits touch 4
blocks at most), and the 35 choices of three blocks are 35 tables whose cells hold all candidate pairs: about
27 bits a cell. The second set are 16 fixed random references: within a cell they discard pairs by maximum
coordinate difference; the survivors are verified on the fingerprints themselves.

Copies of a fingerprint are merged before anything is paired. A cell yields its links as stars or as few
verified pairs, never all pairs. A cell of over ``cell_limit`` fingerprints is dealt out again by the blocks
of its remaining bits in the same exact way, and nothing is capped.

Defined results: null, empty and blank texts have fingerprint 0 and are linked like others; repeated rows
are copies; an empty table stays empty; null ids are never the smallest id of a component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowyard.llm.common import written
from sparrowyard.llm.components import components

#: 16 fixed random reference fingerprints.
REFERENCES = np.random.default_rng(20240229).integers(0, 2**64, 16, np.uint64)


def fingerprint(text: str | None, size: int = 4) -> bytes:
    """Eight bytes, most significant first: the bits set in over half of the hashes of the shingles."""
    import xxhash

    words = text.encode().lower().split() if text else []
    if not words:
        return bytes(8)
    whole, digest = b" ".join(words), xxhash.xxh64_digest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    if len(words) <= size:
        hashes = digest(whole, 42)
    else:
        hashes = b"".join([digest(whole[a:b], 42) for a, b in zip(starts[: 1 - size].tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)])
    rows = np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64)
    n = len(rows)
    counts = np.add.reduceat(rows, np.arange(0, n, 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > n).tobytes()


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 4) -> DataFrame:
    """``id`` and ``fp``, the fingerprint as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = b"".join(fingerprint(t, size) for t in batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.frombuffer(fps, ">i8").astype("i8"))], ["id", "fp"])

    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("t"))
    return rows.mapInArrow(run, rows.select("id").schema.add("fp", "long"))


def _choices(bits: list[int], blocks: int, distance: int) -> list[int]:
    """Masks (as signed longs) of all choices of ``blocks - distance`` blocks of these bits."""
    parts = [sum(1 << int(b) for b in part) for part in np.array_split(np.array(bits), blocks)]
    masks = [sum(c) for c in combinations(parts, blocks - distance)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _cell_links(fp: np.ndarray, starts: np.ndarray, sizes: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links within cells; ``fp`` has the cells one after another."""
    out = []
    table = np.stack([np.bitwise_count(fp ^ r) for r in REFERENCES], axis=1).astype(np.int8) if len(fp) else np.zeros((0, len(REFERENCES)), np.int8)

    def near(a, b) -> np.ndarray:
        ok = np.ones(np.broadcast_shapes(np.shape(a), np.shape(b)), bool)
        for j in range(0, table.shape[1], 4):
            ok &= (np.abs(table[a, j : j + 4] - table[b, j : j + 4]) <= distance).all(axis=-1)
        ok[ok] = np.bitwise_count(fp[np.broadcast_to(a, ok.shape)[ok]] ^ fp[np.broadcast_to(b, ok.shape)[ok]]) <= distance
        return ok

    few = (sizes > 1) & (sizes <= 16)
    at = np.repeat(starts[few], sizes[few]) + np.arange(sizes[few].sum()) - np.repeat(np.cumsum(sizes[few]) - sizes[few], sizes[few])
    ends = np.repeat(starts[few] + sizes[few], sizes[few])
    for lag in range(1, 16):
        at, ends = at[at + lag < ends], ends[at + lag < ends]
        if not len(at):
            break
        ok = near(at, at + lag)
        out.append((fp[at[ok]], fp[at[ok] + lag]))
    for start, size in zip(starts[sizes > 16].tolist(), sizes[sizes > 16].tolist(), strict=True):
        rest = np.arange(start, start + size)
        while len(rest):  # grow one component at a time; who joined is compared no more
            root, front, rest = rest[0], [rest[0]], rest[1:]
            while front and len(rest):
                ok = near(front.pop(), rest)
                front += rest[ok].tolist()
                out.append((np.full(int(ok.sum()), fp[root]), fp[rest[ok]]))
                rest = rest[~ok]
    return out


def _in_cells(cells: DataFrame, distance: int, limit: int | None) -> DataFrame:
    """Links ``u, v`` within cells (``choice``, ``cell``, ``fp``); members of cells beyond ``limit`` come back with v null."""
    dealt = cells.repartition("choice", "cell").sortWithinPartitions("choice", "cell", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []

        def links(rows: np.ndarray) -> pa.RecordBatch:
            new = np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(rows)))
            large = sizes > limit if limit else np.zeros(len(sizes), bool)
            found = _cell_links(rows[:, 2].view(np.uint64), starts[~large], sizes[~large], distance)
            u = np.concatenate([a for a, _ in found] or [np.zeros(0, np.uint64)]).view(np.int64)
            v = np.concatenate([b for _, b in found] or [np.zeros(0, np.uint64)]).view(np.int64)
            again = rows[np.repeat(large, sizes)]
            none = np.zeros(len(u), np.int64)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([u, again[:, 2]])),
                    pa.array(np.concatenate([v, again[:, 2]]), mask=np.arange(len(u) + len(again)) >= len(u)),
                    pa.array(np.concatenate([none, again[:, 0]])),
                    pa.array(np.concatenate([none, again[:, 1]])),
                ],
                ["u", "v", "choice", "cell"],
            )

        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
            if not len(rows):
                continue
            last = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))
            cut = int(last[-1]) + 1 if len(last) else 0
            if kept and (cut or (kept[0][0, :2] != rows[0, :2]).any()):
                if (kept[0][0, :2] != rows[0, :2]).any():
                    yield links(np.concatenate(kept))
                    kept = []
            if cut:
                yield links(np.ascontiguousarray(np.concatenate([*kept, rows[:cut]])))
                kept = []
            kept.append(rows[cut:])
        if kept:
            yield links(np.concatenate(kept))

    return dealt.mapInArrow(run, "u long, v long, choice long, cell long")


def links_of(prints: DataFrame, distance: int = 4, blocks: int = 7, cell_limit: int = 20_000) -> DataFrame:
    """Links ``u, v`` that connect all distinct fingerprints ``fp`` within ``distance`` bits as all pairs would."""
    masks = _choices(list(range(64)), blocks, distance)
    cell = lambda m: F.col("fp").bitwiseAND(F.lit(m))
    cells = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("choice"), cell(m).alias("cell")) for i, m in enumerate(masks)])).alias("c"))
    first = written(_in_cells(cells.select("c.choice", "c.cell", "fp"), distance, cell_limit), "links")
    large = first.where("v is null")
    result = first.where("v is not null").select("u", "v")
    if large.head(1):
        # large cells: the members agree in the bits of the choice, so the other bits are cut into blocks again
        deeper = F.lit(None).cast("array<struct<choice:bigint,cell:bigint>>")
        for i, m in enumerate(masks):
            rest = [b for b in range(64) if not (m >> b) & 1]
            sub = [F.struct(F.xxhash64("choice", "cell", F.lit(j)).alias("choice"), F.col("u").bitwiseAND(F.lit(s)).alias("cell")) for j, s in enumerate(_choices(rest, blocks, distance))]
            deeper = F.when(F.col("choice") == i, F.array(*sub)).otherwise(deeper)
        again = large.select(F.col("u").alias("fp"), F.explode(deeper).alias("c")).select("c.choice", "c.cell", "fp")
        result = result.unionByName(_in_cells(again, distance, None).select("u", "v"))
    return result


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 4, distance: int = 4, blocks: int = 7) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` (smallest id reachable over links) of every row."""
    rows = written(fingerprints(docs, id, text, size), "fingerprints")
    prints = rows.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(links_of(prints.select("fp"), distance, blocks))
    # small against the rows, and joined by key, so no side needs to fit one machine
    rooted = prints.join(roots.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = rooted.join(ids, "root").select("fp", "component_id")
    return rows.join(by_print, "fp").select(F.col("id").alias("doc_id"), "fp", "component_id")


def one_per_group(docs: DataFrame, found: DataFrame, id: str, text: str) -> DataFrame:
    """One row of ``docs`` per ``root`` of ``found`` (``id``, ``h``, ``root``; ``h`` is the text's xxhash64), columns as given.

    The row has the group's smallest id, null last, then the smallest hash. Rows of null or repeated ids
    stay apart unless their texts are in one group.
    """
    stay = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("m")).select(F.col("m.id").alias("i"), F.col("m.h").alias("h"))
    rows = docs.select(F.struct("*").alias("row"), F.col(id).alias("id"), F.xxhash64(text).alias("k"))
    joined = rows.join(stay.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("i")) & (F.col("k") == F.col("h")), "left_semi")
    return joined.groupBy("id", "k").agg(F.first("row").alias("row")).select("row.*")


def deduplicated(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 4, distance: int = 4, blocks: int = 7) -> DataFrame:
    """One row per component, chosen as ``one_per_group`` defines. Columns as given."""
    keyed = docs.select(F.struct(F.col(id).alias("id"), F.xxhash64(text).alias("h")).alias("key"), F.col(text).alias("text"))
    rows = written(fingerprints(keyed, "key", "text", size), "fingerprints")
    roots = components(links_of(rows.select("fp").distinct(), distance, blocks))
    found = rows.join(roots.withColumnRenamed("u", "fp"), "fp", "left").select("id.id", "id.h", F.coalesce("root", "fp").alias("root"))
    return one_per_group(docs, found, id, text)

"""Near-duplicates at a shingle Jaccard similarity of 0.8 and above, each link verified on the shingle sets.

The pivot tables of ``simhash`` come first: fingerprints within 4 bits are linked by them, exactly, and what they link
is verified. At a similarity of 0.8 SimHash fingerprints differ by about 10 of 64 bits, and exact pivot tables for such
a radius would be thousands of choices of blocks, so for what the tables left apart further cells come from MinHash: 20 bands
of 5 values, which a pair at 0.8 misses altogether in 0.04 % of cases and closer pairs more rarely. Within a cell, pairs of
fingerprints that differ by more than ``radius`` bits are discarded (24 is about five deviations above the
mean at 0.8; unrelated ones lie at 32 +- 4), and the rest are compared by their sets of shingles.

Cells of up to 16 texts compare all their pairs. Larger cells compare neighbours, ordered by another band,
so that a large group gives a chain and not the square of its size. Where such a cell still falls into several
components, its texts are banded anew by **wider** bands (60 of 8 values, 130 of 12, 330 of 16), which a pair at 0.8
misses in 0.01 % of cases or fewer, while texts that are less alike part: at 0.7, 17 % share a band of 5
and 0.3 % one of 16. So cells get small enough for all their pairs, and pairs whose least values agree too seldom for the similarity (448 bits of
them, five deviations off) need no verification. What is still mixed after the widest bands is
compared pair by pair in blocks of a cell. No pair is left out for the size of its cell.

Equal texts (in lower case, white space aside) are merged first; null, empty and blank texts are equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from sparrowyard.llm.common import written
from sparrowyard.llm.components import components, contracted, joined
from sparrowyard.llm.simhash import links_of, one_per_group
from sparrowyard.llm.substrings import Paths

BANDS, WIDTH, ALL_PAIRS = 20, 5, 16
#: Bands and their widths for the texts of large cells that fall into several components.
WIDER = ((60, 8), (130, 12), (330, 16))
#: Texts of a cell in a block, where blocks are compared pair by pair.
BLOCK = 512


@cache
def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash functions ``(x ^ flip) * times``."""
    random = np.random.default_rng(20240307)
    return random.integers(0, 2**64, (n, 1), np.uint64), random.integers(0, 2**63, (n, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct shingles; a text of fewer words is one shingle, one without words has none."""
    words = text.encode().lower().split() if text else []
    return np.unique(Paths(words).of(min(size, len(words)))) if words else np.zeros(0, np.uint64)


def _fingerprint(s: np.ndarray) -> int:
    bits = np.unpackbits(s.astype(">u8").view(np.uint8)).reshape(-1, 64)
    return int(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(s)).view(">i8")[0])


#: Words of 64 bits, one bit of each of so many least values. Two texts agree in half of the bits that their similarity leaves.
SIGNATURE = 7
#: The same where blocks are compared: 2048 bits, that is bands and their width, which leave out pairs below a similarity of 0.73 or so and not only of 0.66.
LONG, LONG_OF = 32, (128, 16)


def _agreeing(bits: int, similarity: float) -> int:
    """Bits that texts of this similarity differ in at most, five deviations above their mean."""
    apart = (1 - similarity) / 2
    return int(bits * apart + 5 * (bits * apart * (1 - apart)) ** 0.5)


def _bands(s: np.ndarray, bands: int, width: int, words: int = SIGNATURE) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each band's least values, and the signature; bands of another width have other hashes."""
    flip, times = _functions(bands * width)
    least = np.full(bands * width, 2**64 - 1, np.uint64)
    step = max(64, (1 << 18) // (bands * width))
    for i in range(0, len(s), step):
        least = np.minimum(least, ((s[None, i : i + step] ^ flip) * times).min(axis=1))
    mixed = np.arange(bands, dtype=np.uint64) + np.uint64((width - WIDTH) << 32)
    for column in least.reshape(bands, width).T:
        mixed = (mixed ^ column) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
    signature = np.packbits((least[: 64 * min(words, len(least) // 64)] >> np.uint64(20) & np.uint64(1)).astype(np.uint8)).view(np.int64)
    return mixed.view(np.int64), signature


def sketches(docs: DataFrame, id: str, text: str, size: int) -> DataFrame:
    """``id``, ``h`` (hash of the text as it is), ``c`` (of its words), ``fp`` and ``bands``, none for texts without words."""
    rows = docs.select(F.col(id).alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            copies, fps, bands = [], [], []
            for t in batch.column(2).to_pylist():
                s = shingles(t, size)
                fp, of = (_fingerprint(s), _bands(s, BANDS, WIDTH)[0]) if len(s) else (0, None)
                copies.append(xxhash.xxh3_64_intdigest(b" ".join((t or "").encode().lower().split())))
                fps.append(fp)
                bands.append(of)
            columns = [pa.array(np.array(copies, np.uint64).view(np.int64)), pa.array(fps, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["id", "h", "c", "fp", "bands"])

    return rows.mapInArrow(run, rows.select("id", "h").schema.add("c", "long").add("fp", "long").add("bands", ArrayType(LongType())))


def _by_tables(texts: DataFrame) -> DataFrame:
    """Pairs ``u, v`` to compare that the pivot tables link, from rows ``c, fp``: texts of near fingerprints by the least text of each, and others of a fingerprint with its least."""
    least = written(texts.groupBy("fp").agg(F.min("c").alias("least")), "prints")
    same = texts.join(least, "fp").select(F.col("least").alias("u"), F.col("c").alias("v"))
    of = lambda side: least.select(F.col("fp").alias(side), F.col("least").alias(f"{side}_least"))
    near = links_of(least.select("fp")).join(of("u"), "u").join(of("v"), "v").select(F.col("u_least").alias("u"), F.col("v_least").alias("v"))
    return same.unionByName(near).where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _pairs(cells: DataFrame, radius: int, all_pairs: int, similarity: float) -> DataFrame:
    """Pairs ``u, v`` to compare, from rows ``cell, o, c, fp, root``: all pairs of small cells, neighbours by ``o`` of others.

    Where rows have a signature (columns ``s0`` and so on), pairs that differ in more of it than texts of the similarity do are left out.
    """
    more = [c for c in (f"s{i}" for i in range(LONG)) if c in cells.columns]
    width, apart = 5 + len(more), _agreeing(64 * len(more), similarity)
    dealt = cells.select("cell", "o", "c", "fp", "root", *more).repartition("cell").sortWithinPartitions("cell", "o", "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large = np.zeros((0, width), np.int64), False

        def found(rows: np.ndarray, big: np.ndarray) -> pa.RecordBatch:
            out = []
            for lag in range(1, min(all_pairs, len(rows))):
                a, b = rows[:-lag], rows[lag:]
                ok = (a[:, 0] == b[:, 0]) & (a[:, 4] != b[:, 4])
                if lag > 1:
                    ok &= ~big[:-lag]
                ok[ok] = np.bitwise_count((a[ok, 3] ^ b[ok, 3]).view(np.uint64)) <= radius
                if more:
                    ok[ok] = np.bitwise_count((a[ok, 5:] ^ b[ok, 5:]).view(np.uint64)).sum(axis=1) <= apart
                out.append(np.sort(np.stack([a[ok, 2], b[ok, 2]], axis=1), axis=1))
            pairs = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["u", "v"])

        def sized(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            starts = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]))
            sizes = np.diff(np.append(starts, len(rows)))
            big = sizes > all_pairs
            big[0] |= large
            return starts, np.repeat(big, sizes)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.concatenate([held, np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(width)], axis=1)])
            starts, big = sized(rows)
            if big[-1]:  # the last cell may go on: of a large one its last row is enough, a small one waits
                yield found(rows, big)
                held, large = rows[-1:], True
            else:
                yield found(rows[: starts[-1]], big[: starts[-1]])
                held, large = rows[starts[-1] :], False
        if len(held):
            yield found(held, sized(held)[1])

    return dealt.mapInArrow(run, "u long, v long").distinct()


def _sets(nodes: DataFrame, rows: DataFrame, docs: DataFrame, text: str, size: int) -> DataFrame:
    """``c, s``: the shingles of one text of each node."""
    wanted = rows.join(nodes, "c").groupBy("c").agg(F.min("h").alias("h"))
    texts = docs.select(F.xxhash64(text).alias("h"), F.col(text).alias("t")).join(wanted.hint("shuffle_hash"), "h").select("c", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t, size).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["c", "s"])

    return written(texts.mapInArrow(run, "c long, s binary").dropDuplicates(["c"]), "shingles")


def _banded(sets: DataFrame, bands: int, width: int, most: int = SIGNATURE) -> DataFrame:
    """``c, fp, bands`` of sets, and the signature's words."""
    words = min(most, bands * width // 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
            found = [_bands(s, bands, width, most) for s in of]
            signature = np.stack([x for _, x in found]) if found else np.zeros((0, words), np.int64)
            columns = [pa.array(map(_fingerprint, of), pa.int64()), pa.array([x for x, _ in found], pa.list_(pa.int64())), *[pa.array(x.copy()) for x in signature.T]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["c", "fp", "bands", *[f"s{i}" for i in range(words)]])

    return sets.mapInArrow(run, "c long, fp long, bands array<long>, " + ", ".join(f"s{i} long" for i in range(words)))


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs whose sets of shingles have this Jaccard similarity at least."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True)) if min(len(a), len(b)) >= least * max(len(a), len(b)) - 1e-9 else 0
                ok.append(both >= least * (len(a) + len(b) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(ok, pa.bool_()))

    joined = pairs.join(sets.select(F.col("c").alias("u"), F.col("s").alias("a")), "u").join(sets.select(F.col("c").alias("v"), F.col("s").alias("b")), "v")
    return joined.select("u", "v", "a", "b").mapInArrow(compared, "u long, v long")


def _mixed(cells: DataFrame, all_pairs: int) -> DataFrame:
    """The rows of cells of more than ``all_pairs`` texts that fall into several components, with their cell's size ``n``."""
    cell = Window.partitionBy("cell")
    sized = cells.select("*", F.count("*").over(cell).alias("n"), F.min("root").over(cell).alias("a"), F.max("root").over(cell).alias("b"))
    return sized.where((F.col("n") > all_pairs) & (F.col("a") < F.col("b"))).drop("a", "b")


def _in_blocks(mixed: DataFrame) -> DataFrame:
    """The mixed cells' texts once for each pair of blocks that their own block is in; each pair of blocks is a cell."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = mixed.select("*", blocks.alias("blocks"), F.pmod(F.xxhash64("c"), blocks).cast("int").alias("own"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.withColumn("cell", F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other"))).drop("n", "blocks", "own", "other")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 5, similarity: float = 0.8, radius: int = 24, all_pairs: int = ALL_PAIRS, wider: tuple = WIDER) -> DataFrame:
    """``id``, ``h`` (hash of the text) and ``root``, equal for texts that links connect, of every row."""
    rows = written(sketches(docs, id, text, size), "sketches")
    one = rows.where("bands is not null").groupBy("c").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    texts = written(one, "texts")
    roots, tried, sets = None, None, None

    def compare(pairs: DataFrame) -> None:
        """Verify the pairs that were not compared before, and connect what they link with what is connected."""
        nonlocal roots, tried
        pairs = written(pairs if tried is None else pairs.join(tried, ["u", "v"], "left_anti"), "pairs")
        if not pairs.head(1):
            return
        of = sets or _sets(pairs.select(F.explode(F.array("u", "v")).alias("c")).distinct(), rows, docs, text, size)
        new = written(_verified(pairs, of, similarity), "verified")
        tried = pairs if tried is None else tried.unionByName(pairs)
        if n := new.count():
            roots = written(components(contracted(new, n)) if roots is None else joined(roots, new, n), "roots")

    compare(_by_tables(texts))
    for bands, width in (None, None), *wider, (None, None):
        last = sets is not None and bands is None
        if bands is not None:
            texts = written(_banded(sets.join(mixed, "c", "left_semi"), bands, width), "texts")
        signed = [c for c in texts.columns if c not in ("c", "fp", "bands")]
        cells = texts.select("c", "fp", *signed, F.get("bands", F.lit(0)).alias("o"), F.explode("bands").alias("cell"))
        rooted = lambda: cells.withColumn("root", F.col("c")) if roots is None else cells.join(roots.withColumnRenamed("u", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))  # noqa: B023, E731
        at = rooted()
        if last:
            long = written(_banded(sets.join(mixed, "c", "left_semi"), *LONG_OF, LONG).drop("fp", "bands"), "long")
            at = _in_blocks(_mixed(rooted().drop(*signed), all_pairs)).join(long, "c")
        compare(_pairs(at, radius, 4 * BLOCK if last else all_pairs, similarity))
        if last:
            break
        mixed = written(_mixed(rooted().select("cell", "c", "root"), all_pairs).select("c").distinct(), "mixed")
        if not mixed.head(1):
            break
        sets = sets or _sets(mixed, rows, docs, text, size)
    if roots is None:
        return rows.select("id", "h", F.col("c").alias("root"))
    return rows.join(roots.withColumnRenamed("u", "c"), "c", "left").select("id", "h", F.coalesce("root", "c").alias("root"))


def deduplicated(docs: DataFrame, id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row per component, chosen as ``one_per_group`` defines. Columns as given."""
    return one_per_group(docs, near_duplicates(docs, id, text, **how), id, text)

"""Removal of long repeated passages by prefix-partitioned suffix trees over sampled suffixes.

Every position of a text starts a suffix, and a window of W words is the path of its suffix to depth W. A
tree over all suffixes of a corpus does not fit anywhere, so:

1. Copies. Of rows with one text only the one with the smallest id can be the earlier document of any window, and
   the others lose all words; so only the first row of each text goes on.
2. Sampling. In each window the k-word prefix with the smallest hash is the window's anchor. Equal windows
   have equal anchors, so suffixes whose anchor occurs in one text only cannot repeat. One compact row
   per anchor (about one in 18 words) finds them.
3. Partitioning. The remaining suffixes are dealt out by a prefix: the k words of their anchor, and for an anchor
   that occurs over ``group_limit`` times all W words of the suffix, which equal windows share. So the groups are
   memory-sized. Before that, each batch of documents settles what repeats inside it: of equal paths only the one
   with the smallest id travels on, so a passage in a third of all documents arrives once per batch.
4. Subtrees. Within a group the suffixes are put in the order of their words by prefix doubling: ranks of 1, 2, 4, ...
   words, each from pairs of the ranks before, up to depth W. Suffixes of one rank at depth W hang below one deep
   internal node of the group's tree; all of them but those of the smallest id are repeats. Repeats at neighbouring
   positions join into maximal ones.

Windows are compared by their words, but for those of anchors beyond ``group_limit``, which are compared by two
64-bit hashes of the whole path. Texts are taken whole. Defined results: null and empty texts have no words;
texts under W words keep all; a document with a null id is no earlier document and loses nothing; rows that repeat
an id do not remove each other's words; ids are of an integer type, others raise TypeError; other columns are kept
in ``row``; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowyard.llm.common import integer_id, written

_B = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = _powers[name] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n, 1 << 15), base, np.uint64))])
    return have[:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Paths:
    """Rolling hashes over the words of a text."""

    def __init__(self, words: list[bytes]):
        import xxhash

        n = len(words)
        w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(w * _power(_B, n, "up"), dtype=np.uint64)])
        self.back = _power(pow(_B, -1, 2**64), n + 1, "down")

    def of(self, depth: int) -> np.ndarray:
        """Hash of the path of each suffix to this depth."""
        sums = self.sums[depth:] - self.sums[:-depth]
        return _mixed(sums * self.back[: len(sums)])


def anchors(paths: Paths, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first window and number of windows, for each run of windows with one anchor."""
    prefix = paths.of(k)
    span = window - k + 1
    at = np.lib.stride_tricks.sliding_window_view(prefix, span).argmin(axis=1) + np.arange(len(prefix) - span + 1)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return prefix[at[first]], first, np.diff(np.append(first, len(at)))


def suffix_ranks(words: list[bytes], depth: int) -> np.ndarray:
    """Rank, in the order of their first ``depth`` words, of the suffixes that have so many; equal ranks are equal words.

    Prefix doubling: the rank at depth 2d of a suffix is that of the pair of ranks at depth d, d words apart.
    """
    d = pa.array(words, pa.binary()).dictionary_encode()
    place = np.empty(len(d.dictionary), np.int64)
    place[pc.sort_indices(d.dictionary).to_numpy()] = np.arange(len(place))
    rank, have = place[d.indices.to_numpy()], 1
    while have < depth and len(rank):
        step = min(have, depth - have)
        pair = rank[: len(rank) - step] * np.int64(int(rank.max()) + 1) + rank[step:]
        rank, have = np.unique(pair, return_inverse=True)[1], have + step
    return rank


def _repeats(node: tuple[np.ndarray, ...], id: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of suffixes given by the parts of their node's name and their document: which repeat one of a smaller id, and which are of the smallest."""
    order = np.lexsort((id, *node))
    i = id[order]
    new = np.concatenate([[True], np.any([n[order][1:] != n[order][:-1] for n in node], axis=0)]) if len(i) else np.zeros(0, bool)
    least = i[np.flatnonzero(new)][np.cumsum(new) - 1] if len(i) else i
    repeat, first = np.zeros(len(i), bool), np.zeros(len(i), bool)
    repeat[order] = i > least
    first[order] = i == least
    return repeat, first


def _starts(n: np.ndarray, window: int) -> np.ndarray:
    """Where each of n windows begins among the words of runs of n + window - 1 words, one run after another."""
    return np.arange(n.sum()) + np.repeat(np.arange(len(n)) * (window - 1), n)


def _runs(owner: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Repeated windows (owner, position) as maximal word ranges: owner, start, end."""
    order = np.lexsort((at, owner))
    owner, at = owner[order], at[order]
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (at[1:] > at[:-1] + window)]) if len(at) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1 if len(at) else first
    return owner[first], at[first], at[last] + window


OUT = "key long, id long, k long, at int, n int, words binary, path long"


def _suffixes(docs: DataFrame, window: int, k: int, batch_words: int = 200_000) -> DataFrame:
    """Suffixes by key: a run of n windows with its words, or one window of a frequent anchor with its second path hash.

    Rows with neither are ranges of n words that are known to repeat. ``starts`` has the windows to take; those of a
    frequent anchor are given as -1 - start.
    """

    def settle(rows: list) -> pa.RecordBatch:
        # rows: id, text hash, words, and per run of windows: anchor, first window, number, frequent
        n = np.concatenate([r[5] for r in rows])
        first = np.concatenate([r[4] for r in rows])
        doc = np.repeat(np.arange(len(rows)), [len(r[5]) for r in rows])
        words: list[bytes] = []
        for r in rows:
            for a, m in zip(r[4].tolist(), r[5].tolist(), strict=True):
                words += r[2][a : a + m + window - 1]
        begin = _starts(n, window)
        node = suffix_ranks(words, window)[begin]
        owner, run = np.repeat(doc, n), np.repeat(np.arange(len(n)), n)
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        ids, keys = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
        repeat, least = _repeats((node,), ids[owner])
        who, start, end = _runs(owner[repeat], at[repeat], window)
        often = np.concatenate([r[6] for r in rows])[run]
        anchor = np.concatenate([r[3] for r in rows])
        # of frequent anchors, each window by itself, by its whole path
        one = np.flatnonzero(least & often)
        paths = [Paths(words[b : b + window]) for b in begin[one].tolist()] if len(one) else []
        key1 = np.array([int(p.of(window)[0]) for p in paths], np.uint64)
        key2 = np.array([_second(words[b : b + window]) for b in begin[one].tolist()], np.uint64)
        # of others, what is left of each run
        keep = np.flatnonzero(least & ~often)
        new = np.flatnonzero(np.concatenate([[True], (run[keep][1:] != run[keep][:-1]) | (at[keep][1:] != at[keep][:-1] + 1)])) if len(keep) else np.zeros(0, int)
        head, size = keep[new], np.diff(np.append(new, len(keep)))
        texts = [b" ".join(words[b : b + m + window - 1]) for b, m in zip(begin[head].tolist(), size.tolist(), strict=True)]
        none = lambda m: [None] * m
        return pa.RecordBatch.from_arrays(
            [
                # known ranges may go anywhere; the document's id spreads them, which copies of a text do not share
                pa.array(np.concatenate([ids[who], key1.view(np.int64), anchor[run[head]].view(np.int64)])),
                pa.array(np.concatenate([ids[who], ids[owner[one]], ids[owner[head]]])),
                pa.array(np.concatenate([keys[who], keys[owner[one]], keys[owner[head]]])),
                pa.array(np.concatenate([start, at[one], at[head]]).astype(np.int32)),
                pa.array(np.concatenate([end - start, np.ones(len(one), np.int64), size]).astype(np.int32)),
                pa.array(none(len(who) + len(one)) + texts, pa.binary()),
                pa.array(none(len(who)) + key2.view(np.int64).tolist() + none(len(head)), pa.int64()),
            ],
            ["key", "id", "k", "at", "n", "words", "path"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for id, key, text, starts in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                words = text.encode().split()
                anchor, first, n = anchors(Paths(words), window, k)
                starts = np.array(starts)
                mine = np.isin(first, np.where(starts < 0, -1 - starts, starts))
                anchor, first, n = anchor[mine], first[mine], n[mine]
                rows.append((id, key, words, anchor, first, n, np.isin(first, -1 - starts)))
                size += int(n.sum())
                if size >= batch_words:
                    yield settle(rows)
                    rows, size = [], 0
        if rows:
            yield settle(rows)

    return docs.mapInArrow(run, OUT)


def _second(words: list[bytes]) -> int:
    """Another hash of a path, apart from the one that deals it out."""
    import xxhash

    return xxhash.xxh3_64_intdigest(b" ".join(words), 97)


def _subtrees(suffixes: DataFrame, window: int, batch_rows: int = 12_000) -> DataFrame:
    """Word ranges that repeat: ``id, k, start, end``. A batch is whole groups."""
    dealt = suffixes.repartition("key").sortWithinPartitions("key")

    def settle(tables: list[pa.Table]) -> pa.RecordBatch:
        t = pa.concat_tables(tables)
        get = lambda c: t.column(c).to_numpy()
        key, id, k, at, n = (get(c) for c in ("key", "id", "k", "at", "n"))
        texts = t.column("words").to_pylist()
        tree = np.array([x is not None for x in texts], bool)
        hashed = t.column("path").is_valid().to_numpy()
        known = ~tree & ~hashed
        # the subtrees, by the order of their words
        rows, words = np.flatnonzero(tree), []
        for x in texts:
            if x is not None:
                words += x.split(b" ")
        size = n[rows]
        owner = np.repeat(rows, size)
        where = np.repeat(at[rows] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        repeat, _ = _repeats((suffix_ranks(words, window)[_starts(size, window)],), id[owner])
        # windows of frequent anchors
        one = np.flatnonzero(hashed)
        again, _ = _repeats((t.column("path").fill_null(0).to_numpy()[one], key[one]), id[one])
        who, start, end = _runs(np.concatenate([owner[repeat], one[again]]), np.concatenate([where[repeat], at[one[again]]]), window)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(x)) for x in ((id[who], id[known]), (k[who], k[known]), (start.astype(np.int32), at[known]), (end.astype(np.int32), at[known] + n[known]))],
            ["id", "k", "start", "end"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            key = t.column("key").to_numpy()
            other = np.flatnonzero(key != key[-1])
            cut = int(other[-1]) + 1 if len(other) else 0
            if size >= batch_rows and (cut or held[-1].column("key")[-1].as_py() != key[0]):
                if held[-1].column("key")[-1].as_py() != key[0]:
                    cut = 0
                yield settle([*held, t.slice(0, cut)])
                held, size, t = [], 0, t.slice(cut)
            held.append(t)
            size += t.num_rows
        if held:
            yield settle(held)

    return dealt.mapInArrow(run, "id long, k long, start int, end int")


def _copies(docs: DataFrame, id: str, text: str) -> DataFrame:
    """``id, k`` of the rows whose text a row with a smaller id has; ``k`` is the text's 64-bit hash, the comparison is by SHA-256."""
    named = docs.where(F.col(id).isNotNull() & F.col(text).isNotNull()).select(F.col(id).cast("long").alias("id"), F.xxhash64(text).alias("k"), F.sha2(F.col(text).cast("binary"), 256).alias("sha"))
    named = written(named, "texts")
    first = named.groupBy("k", "sha").agg(F.min("id").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    return written(named.join(first, ["k", "sha"]).where("id > first").select("id", "k").distinct(), "copies")


#: Frequent anchors that are broadcast at most, 8 bytes each.
BROADCAST_ROWS = 1_000_000


def _dealt(docs: DataFrame, copies: DataFrame, id: str, text: str, window: int, k: int, group_limit: int) -> DataFrame:
    """The suffixes of first rows whose anchors several texts have, by the key that deals them out."""
    rows = docs.where(F.col(id).isNotNull() & F.col(text).isNotNull()).select(F.col(id).cast("long").alias("id"), F.xxhash64(text).alias("k"), F.col(text).alias("t"))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for i, key, t in zip(*[batch.column(j).to_pylist() for j in range(3)], strict=True):
                words = t.encode().split()
                if len(words) >= window:
                    anchor, first, _ = anchors(Paths(words), window, k)
                    parts.append((anchor.view(np.int64), np.full(len(first), i), np.full(len(first), key), first.astype(np.int32)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], ["anchor", "id", "k", "at"])

    found = rows.mapInArrow(sample, "anchor long, id long, k long, at int")
    found = written(found, "anchors")
    counted = found.groupBy("anchor").agg(F.min("k").alias("a"), F.max("k").alias("b"), F.count("*").alias("c")).where("a < b")
    shared = written(counted.select("anchor", (F.col("c") > group_limit).alias("frequent")), "shared")
    frequent = shared.where("frequent").select("anchor")
    # a frequent anchor joined by key would be one task's, so the few of them go to every task; too many are joined by key
    if frequent.count() <= BROADCAST_ROWS:
        frequent = F.broadcast(frequent)
    often = found.join(frequent, "anchor").withColumn("at", -1 - F.col("at"))
    seldom = found.join(frequent, "anchor", "left_anti").join(shared.where("not frequent").select("anchor"), "anchor")
    starts = seldom.unionByName(often).groupBy("id", "k").agg(F.collect_set("at").alias("starts")).join(copies, ["id", "k"], "left_anti")
    wanted = rows.join(starts.hint("shuffle_hash"), ["id", "k"]).select("id", "k", "t", "starts")
    return _suffixes(wanted, window, k)


def repeated_ranges(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = 50, k: int = 16, group_limit: int = 8_000) -> DataFrame:
    """Word ranges (``id, k, start, end``) covered by windows that also start in a document with a smaller id; ``k`` is the text's hash.

    The range of a copy of an earlier text is given as 0 to -1: all words, if they make a window.
    """
    integer_id(docs, id)
    copies = _copies(docs, id, text)
    whole = copies.select("id", "k", F.lit(0).alias("start"), F.lit(-1).alias("end"))
    return _subtrees(_dealt(docs, copies, id, text, window, k, group_limit), window).unionByName(whole)


def without_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = 50, k: int = 16) -> DataFrame:
    """``row`` (the input's columns but the text), ``n_words``, ``n_removed`` and ``kept``, the remaining words joined by a space.

    A document's list of ranges is bounded by its own length.
    """
    ranges = written(repeated_ranges(docs, id, text, window, k), "ranges")
    lists = ranges.groupBy("id", "k").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    others = [c for c in docs.columns if c != text]
    rows = docs.select(F.struct(*others).alias("row"), F.col(id).cast("long").alias("id"), F.xxhash64(text).alias("k"), F.col(text).alias("t"))
    joined = rows.join(lists.hint("shuffle_hash"), ["id", "k"], "left").select("row", "t", "starts", "ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, removed, kept = [], [], []
            for t, starts, ends in zip(*[batch.column(i).to_pylist() for i in (1, 2, 3)], strict=True):
                words = t.encode().split() if t else []
                gone = 0
                if starts and -1 in ends:  # a copy
                    if len(words) >= window:
                        words, gone = [], len(words)
                    n = len(words) + gone
                elif starts:
                    left, at = [], 0
                    for a, b in sorted(zip(starts, ends, strict=True)):
                        left += words[at:a] if a > at else []
                        gone += max(0, b - max(a, at))
                        at = max(at, b)
                    words, n = left + words[at:], len(words)
                else:
                    n = len(words)
                totals.append(n)
                removed.append(gone)
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["row", "n_words", "n_removed", "kept"])

    schema = joined.select("row").schema.add("n_words", "long").add("n_removed", "long").add("kept", "string")
    return joined.mapInArrow(run, schema)


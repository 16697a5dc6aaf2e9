"""Items that share tags with users, found block by block of items, so that no match goes through a shuffle.

Items are cut by their ids into blocks of about ``LISTED`` rows of a tag, and a block's users (those with a tag that stands in it) into parts of about
``ASKED``. A **cell** is a block with one of its parts: an item lies whole in its block, so a cell tells all that a user and an item share. Users lie
in as many cells as their tags have blocks, and only a cell's ``n`` best of a user leave it.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowyard.operators.cycles import pieces

#: Tags of a block's items, users of a cell, and matches looked at together, roughly.
LISTED, ASKED, MATCHES = 1_000_000, 20_000, 1 << 20


def rounded(x: np.ndarray, digits: int = 9) -> np.ndarray:
    """Numbers in the order of Spark's ``round`` (half up on the shortest decimal form): equal where it makes equal numbers."""
    y = x * 10.0**digits
    out = np.rint(y)
    for i in np.flatnonzero((np.abs(y - np.floor(y) - 0.5) < 1e-3) | ((np.abs(y) > 1e12) & np.isfinite(y))).tolist():
        out[i] = float(Decimal(repr(float(x[i]))).scaleb(digits).quantize(Decimal(1), ROUND_HALF_UP))
    return np.where(np.isnan(y), np.inf, out)


class Block:
    """A block's items, in the order of their ids, listed by tag."""

    def __init__(self, rows: pa.Table):
        self.items, lists = rows["item"].combine_chunks(), rows["tags"].combine_chunks()
        coded = lists.flatten().dictionary_encode()
        self.known, code = coded.dictionary, coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        item = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        order = np.argsort(code, kind="stable")[np.count_nonzero(code < 0) :]
        self.item, self.total, self.rows = item[order], rows["totals"].combine_chunks().flatten().to_numpy()[order], rows["rows"].combine_chunks().flatten().to_numpy()[order]
        self.begin = np.searchsorted(code[order], np.arange(len(self.known) + 1))

    def best(self, users: pa.Table, n: int, matches: int = MATCHES) -> Iterator[pa.RecordBatch]:
        """The ``n`` best unseen items of each user: by matched tags, mean score and id."""
        tags, seen, size = users["tags"].combine_chunks(), users["seen"].combine_chunks(), np.int64(max(1, len(self.items)))
        code = pc.index_in(tags.flatten(), self.known, skip_nulls=True).fill_null(-1).to_numpy(zero_copy_only=False)
        user = np.repeat(np.arange(users.num_rows), tags.value_lengths().to_numpy())[code >= 0]
        begin, end = self.begin[code[code >= 0]], self.begin[code[code >= 0] + 1]
        no = pc.index_in(seen.flatten(), self.items, skip_nulls=True).fill_null(-1).to_numpy(zero_copy_only=False)
        left_out = np.sort((np.repeat(np.arange(users.num_rows), seen.value_lengths().to_numpy()) * size + no)[no >= 0])
        upto = np.cumsum(np.bincount(user, end - begin, users.num_rows).astype(np.int64))
        s = 0
        while s < users.num_rows:
            e = max(s + 1, int(np.searchsorted(upto, (upto[s - 1] if s else 0) + matches, "right")))
            a, b = np.searchsorted(user, [s, e])
            for of, at in pieces(begin[a:b], end[a:b], 1 << 62):
                who, item, matched, total, rows = self.counted(user[a:b][of] - s, at, size)
                new = ~np.isin(who * size + item, left_out[slice(*np.searchsorted(left_out, [s * size, e * size]))] - s * size)
                # of items below the n-th number of matched tags none can be among the n best
                most = int(matched.max()) + 1
                counts = np.bincount(who[new] * most + matched[new], minlength=(e - s) * most).reshape(e - s, most)[:, ::-1].cumsum(1)
                least = np.where(counts[:, -1] >= n, most - 1 - np.argmax(counts >= n, axis=1), 0)
                at = np.flatnonzero(new & (matched >= least[who]))
                at = at[np.lexsort((item[at], -rounded(total[at] / rows[at]), -matched[at], who[at]))]
                first = np.searchsorted(who[at], who[at])
                at = at[np.arange(len(at)) - first < n]
                if len(at):
                    yield pa.RecordBatch.from_arrays([users["user"].combine_chunks().take(pa.array(who[at] + s)), self.items.take(pa.array(item[at])), pa.array(matched[at]), pa.array(total[at]), pa.array(rows[at])], ["user", "item", "matched_tags", "total", "rows"])
            s = e

    def counted(self, user: np.ndarray, at: np.ndarray, size: np.int64) -> tuple[np.ndarray, ...]:
        """Each pair of user and item that shares a tag, in order: their tags, and the sums of total and rows."""
        key = user * size + self.item[at]
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        return key[first] // size, key[first] % size, np.diff(first, append=len(key)), np.add.reduceat(self.total[at], first), np.add.reduceat(self.rows[at], first)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    """Stretches of equal ``block, part, side``, as the batches have them."""
    for b in batches:
        if b.num_rows:
            keys = np.stack([b.column(i).to_numpy() for i in range(3)])
            cuts = [0, *(np.flatnonzero((np.diff(keys) != 0).any(0)) + 1).tolist(), b.num_rows]
            for s, e in zip(cuts, cuts[1:], strict=False):
                yield tuple(keys[:, s].tolist()), pa.Table.from_batches([b.slice(s, e - s)])


def best(items: DataFrame, users: DataFrame, n: int) -> DataFrame:
    """``user, item, matched_tags, total, rows``: of each cell the ``n`` best unseen items of each user.

    ``items`` has ``block, part, item, tags, totals, rows`` with an entry a tag in each array, ``users`` has ``block, part, user, tags, seen``.
    """
    types = {**{f.name: f.dataType.simpleString() for f in items.schema}, **{f.name: f.dataType.simpleString() for f in users.schema}}
    none = lambda c: F.lit(None).cast(types[c]).alias(c)
    listed = items.select("block", "part", F.lit(0).alias("side"), "item", "tags", "totals", "rows", none("user"), none("seen"))
    asking = users.select("block", "part", F.lit(1).alias("side"), none("item"), "tags", none("totals"), none("rows"), "user", "seen")
    rows = listed.unionByName(asking).repartition("block", "part").sortWithinPartitions("block", "part", "side", "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cell, block = [], None, None
        for (*at, side), table in _runs(batches):
            if cell != at:
                held, cell, block = [], at, None
            if side == 0:
                held.append(table)
                continue
            if block is None and held:
                block, held = Block(pa.concat_tables(held)), []
            if block is not None:
                yield from block.best(table, n)

    return rows.mapInArrow(run, f"user {types['user']}, item {types['item']}, matched_tags long, total double, rows long")

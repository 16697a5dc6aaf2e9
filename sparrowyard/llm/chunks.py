"""A distinct-chunk table: ids of each distinct chunk of text, made once and joined back by position.

It serves tokenizers whose tokens never reach across chunk borders. Texts are cut, and their chunks made
distinct, by Arrow's kernels in slices of a few megabytes; a slice's distinct chunks get their ids from a
table that the Python worker keeps over slices and tasks, and the ids go back to every occurrence by position.
The table holds at most ``limit`` chunks and starts anew when full, which costs time, never results. A table
for the whole corpus would need the texts, or every occurrence of every chunk, shuffled to it and back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks beyond this many characters are rare and are not kept.
LONG = 64


def slices(batch: pa.RecordBatch, column: int, size: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The rows in order, cut where about ``size`` bytes of this text column are full; no text is split."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def word_lists(texts: pa.Array) -> pa.ListArray:
    """The words of each text; null texts have none."""
    parts = pc.split_pattern_regex(pc.fill_null(texts, ""), r"[\x20\x09-\x0D]+")
    flat = parts.flatten()
    real = pc.not_equal(flat, "")
    upto = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    cuts = upto[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), flat.filter(real))


def _spread(starts: np.ndarray, lengths: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The ranges of ``values`` one after another."""
    ends = np.cumsum(lengths)
    return values[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)]


class ChunkTable:
    """Numbers of chunks, and the ids of each number.

    ``encode`` maps new chunks to all their ids in order and the count of each.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 600_000):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.lengths, self.starts, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def numbered(self, chunks: list[str], distinct: bool = False) -> np.ndarray:
        """Numbers of chunks, valid until the next call; what is new is encoded first. ``distinct``: no chunk is given twice."""
        if len(self.lengths) > self.limit:
            self.clear()
        out = np.fromiter(map(self.numbers.get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(out < 0).tolist()
        if missing:
            first = len(self.lengths)
            new = [chunks[i] for i in missing]
            new = new if distinct else list(dict.fromkeys(new))
            flat, lengths = self.encode(new)
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
            self.lengths, self.flat = np.concatenate([self.lengths, lengths]), np.concatenate([self.flat, flat.astype(np.int32)])
            fresh = dict(zip(new, range(first, first + len(new)), strict=True))
            out[missing] = np.arange(first, first + len(new)) if distinct else [fresh[chunks[i]] for i in missing]
            self.numbers.update(fresh if max(map(len, new)) <= LONG else {c: n for c, n in fresh.items() if len(c) <= LONG})
        return out

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each chunk has."""
        n = self.lengths[numbers]
        return _spread(self.starts[numbers], n, self.flat), n

    def encoded(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``ids``, for an array with repeated chunks: each distinct one is looked up once."""
        d = chunks.dictionary_encode()
        return self.ids(self.numbered(d.dictionary.to_pylist(), distinct=True)[d.indices.to_numpy()]) if len(d) else (np.zeros(0, np.int32), np.zeros(0, np.int64))


def joined(chunks: pa.ListArray, table: ChunkTable, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of lists of chunks, each list closed by the end id: all ids, and where each list begins, one more for the end."""
    cuts = chunks.offsets.to_numpy() - chunks.offsets[0].as_py()
    ids, n = table.encoded(chunks.flatten())
    upto = np.concatenate([[0], np.cumsum(n)])[cuts]
    return np.insert(ids, upto[1:], end), upto + np.arange(len(cuts))

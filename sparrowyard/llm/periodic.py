"""Periodic runs of words: maximal stretches that repeat with a period, found with a suffix automaton and link-cut access.

A run is a stretch of consecutive words whose smallest period q fits twice into it, of ``min_length`` words at
least, that no neighbouring word extends. For one text, the suffix automaton of its words is built; the links of
the automaton form a tree, in which the way from a prefix's state up to the root holds all of the prefix's
suffixes. The words are then appended one by one: a **link-cut access** walks up from the new prefix's state and
recolours that way with the new end. The old colours come in path segments; a segment of colour ``e'`` whose
longest string has L words ends at both ``e'`` and the new end e, so if ``e - e' <= L`` the words before e
repeat at the distance ``p = e - e'``: a square. Every primitively rooted square is met so, as its root occurs
nowhere between its two halves. A square's run reaches L + p words back, which is as far as it goes, and forward
while words repeat. Segments change O(n log n) times in all, and nodes of a segment form a splay tree.

Words within a run are repeated at the distance of the period over half of ``min_length`` consecutive words at
least, so only stretches covered by such repeated sequences (found for a whole slice of texts with array
operations) are given to the automaton: nothing is lost, as a run lies within one of these stretches.

One text is worked on in one task, since a run's words are in order; memory is about 1 kB a word of a repeated
stretch. Defined results: null and blank texts have no words and no runs; repeated rows are rows of their own;
ids are carried, not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowyard.llm.chunks import slices, word_lists


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix automaton: link and longest length of each state, and each prefix's state. State 1 is the root, 0 none."""
    step: list[dict[int, int]] = [{}, {}]
    link, length, prefix = [0, 0], [0, 0], []
    last = 1
    for n, w in enumerate(words, 1):
        new = len(step)
        step.append({})
        link.append(0)
        length.append(n)
        at = last
        while at and w not in step[at]:
            step[at][w] = new
            at = link[at]
        if not at:
            link[new] = 1
        else:
            to = step[at][w]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                twin = len(step)
                step.append(dict(step[to]))
                link.append(link[to])
                length.append(length[at] + 1)
                link[to] = link[new] = twin
                while at and step[at].get(w) == to:
                    step[at][w] = twin
                    at = link[at]
        last = new
        prefix.append(new)
    return link, length, prefix


def _splayed(x: int, left: list[int], right: list[int], up: list[int], colour: list[int]) -> None:
    """Make ``x`` the root of its splay tree; the tree's colour stands at its root."""
    while True:
        p = up[x]
        if not p or (left[p] != x and right[p] != x):
            return
        g = up[p]
        inner = bool(g) and (left[g] == p or right[g] == p)
        if inner:
            first = p if (left[p] == x) == (left[g] == p) else x  # zig-zig turns the parent first
            order = (first, x)
        else:
            colour[x] = colour[p]
            order = (x,)
        for y in order:
            p = up[y]
            g = up[p]
            if left[p] == y:
                c = left[p] = right[y]
                right[y] = p
            else:
                c = right[p] = left[y]
                left[y] = p
            if c:
                up[c] = p
            up[p] = y
            up[y] = g
            if g:
                if left[g] == p:
                    left[g] = y
                elif right[g] == p:
                    right[g] = y
                else:
                    colour[y] = colour[p]
            else:
                colour[y] = colour[p]


def runs_of(words: list[int], min_length: int = 12) -> list[tuple[int, int, int]]:
    """Runs ``(start, length, period)`` by start, then period, of a sequence of word numbers."""
    link, length, prefix = automaton(words)
    # each state is a splay tree of its own, hung below its link; the root holds the empty string only and is left out
    up = [0 if p == 1 else p for p in link]
    left, right, colour = [0] * len(link), [0] * len(link), [-1] * len(link)
    ends: dict[int, int] = {}
    found: dict[tuple[int, int], int] = {}
    n = len(words)
    for e, x in enumerate(prefix):
        below = 0
        while x:
            _splayed(x, left, right, up, colour)
            before = colour[x]
            if before >= 0:
                p = e - before
                if p <= length[x] and ends.get(p, 0) <= e:
                    stop = e + 1
                    while stop < n and words[stop] == words[stop - p]:
                        stop += 1
                    ends[p] = stop
                    start = before - length[x] + 1
                    if stop - start >= min_length:
                        key = (start, stop)
                        found[key] = min(p, found.get(key, p))  # a multiple of the smallest period gives the same stretch
            cut = right[x]
            if cut:
                colour[cut] = before
            right[x] = below
            below = x
            x = up[x]
        colour[below] = e
    return sorted(((s, t - s, p) for (s, t), p in found.items()), key=lambda r: (r[0], r[2]))


def repeated_stretches(ids: np.ndarray, cuts: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the longest stretches covered by sequences of ``gram`` words that their text has twice or more."""
    n = len(ids) - gram + 1
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(cuts) - 1, dtype=np.uint64), np.diff(cuts))
    h = text[:n] * np.uint64(0x9E3779B97F4A7C15)
    for k in range(gram):
        h = (h ^ ids[k : n + k].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    inside = np.flatnonzero(text[:n] == text[gram - 1 :])
    order = inside[np.argsort(h[inside], kind="stable")]
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(len(order) + 1, bool)
    twice[1:-1] = same
    at = order[twice[1:] | twice[:-1]]  # equal hashes of different words only make a stretch longer
    depth = np.zeros(len(ids) + 1, np.int64)
    np.add.at(depth, at, 1)
    np.add.at(depth, at + gram, -1)
    covered = np.concatenate([[False], np.cumsum(depth[:-1]) > 0, [False]])
    # two texts' stretches may touch
    begin = covered[1:-1] & (~covered[:-2] | np.isin(np.arange(len(ids)), cuts))
    end = covered[1:-1] & (~covered[2:] | np.isin(np.arange(1, len(ids) + 1), cuts))
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def periodic_runs(docs: DataFrame, text: str = "text", keep: list[str] | None = None, min_length: int = 12) -> DataFrame:
    """``row`` (the kept columns, all by default), ``n_words``, ``runs`` and ``collapsed`` per document.

    ``runs`` lists ``start, length, period`` by start, then period; ``collapsed`` is the text without the words that
    some run contains after its first period, joined by single spaces.
    """
    rows = docs.select(F.struct(*(keep or ["*"])).alias("row"), F.col(text).alias("t"))
    kind = "array<struct<start:long,length:long,period:long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                words = word_lists(part.column(1))
                cuts = words.offsets.to_numpy().astype(np.int64)
                ids = words.flatten().dictionary_encode().indices.to_numpy() if cuts[-1] else np.zeros(0, np.int32)
                dropped, found, count = np.zeros(len(ids), bool), [], np.zeros(part.num_rows, np.int64)
                for a, b in zip(*repeated_stretches(ids, cuts, -(-min_length // 2)), strict=True):
                    if b - a < min_length:
                        continue
                    doc = int(np.searchsorted(cuts, a, "right")) - 1
                    for s, length, p in runs_of(ids[a:b].tolist(), min_length):
                        found.append((a + s - cuts[doc], length, p))
                        dropped[a + s + p : a + s + length] = True
                        count[doc] += 1
                columns = np.array(found, np.int64).reshape(-1, 3).T
                runs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.StructArray.from_arrays([pa.array(c) for c in columns], ["start", "length", "period"]))
                kept = np.concatenate([[0], np.cumsum(~dropped)])[cuts]
                left = pa.ListArray.from_arrays(pa.array(kept, pa.int32()), words.flatten().filter(pa.array(~dropped)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(cuts)), runs, pc.binary_join(left, " ")], ["row", "n_words", "runs", "collapsed"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, n_words long, runs {kind}, collapsed string")


def looped(words: Column, at: Column, period: Column) -> Column:
    """The words joined by spaces, where those from number ``at`` on repeat the first ``period`` of them."""
    there = F.slice(words, at + 1, period)
    tail = F.flatten(F.array_repeat(there, F.ceil((F.size(words) - at) / period).cast("int")))
    return F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), at), tail), F.lit(1), F.size(words)), " ")

"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A token (a word, or the end of a text) is coded as the first ``BITS`` bits of its hash, one binary decision after
the other. Bit predictors give each decision a log-odds:

* **order 0**: how often training tokens took either branch of the code's tree;
* **order 1**: the same for training tokens after the same hashed previous token;
* **match**: the token that followed the last place of the same two (or one) previous tokens in this text.

The predictors are mixed in the logistic domain, ``p = squash(sum(w * stretch(p_i)))``. The weights are gated: a set
is chosen by what order 1 has seen, by the match and by the depth. They start from a fit on all decisions of all training
texts, each token's own occurrence taken off the counts, and are **refined online**: after each ``BLOCK`` tokens of a text, its own weights take a gradient step
on the decisions just coded. Tokens of one code are told apart by their training counts, with 0.1 for one that
training never saw, so the probabilities of all tokens add up to one. Bits per byte follow from the total.

On Spark: texts become slices of tokens with each slice's distinct keys (words, contexts with the first ``HIGH``
bits, pairs of contexts and codes), counted where they stand. Keys are dealt out in compressed blocks by ranges of
hashes, counts are added up per key over the corpus, and each slice gets its keys' counts back, with those of the
branches along their codes that none of its keys takes. From these a slice first tallies its training texts' decisions by gate
and rounded inputs; tallies are added up and fitted gate by gate, and the weights go back to the slices, whose counts Spark
shuffles once for both.
A context that many texts share is dealt out by the first ``HIGH`` bits of what follows, so none is one task, and a
slice sends a key once however often it has it. What is gathered grows with the corpus: all its words and pairs. The driver sees
counts of 65,536 code prefixes and three sums.

Words are told apart by 64-bit hashes (XXH64); among a billion words one pair collides with a chance of 3 %.
Defined results: null texts are empty, an empty text is its end alone; ids are read as text for the split,
null ids are learned from; repeated rows count once each; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowyard.llm.chunks import slices, word_lists
from sparrowyard.llm.common import scratch_path, written

#: Bits of a code, those of its first block, those that the driver has counts of, and those of a hashed context.
BITS, HIGH, TOP, CONTEXT = 20, 8, 16, 18
#: Tokens between two refinements of a text's weights.
BLOCK = 64
#: Kinds of keys, and of whole slices.
WORDS, CONTEXTS, PAIRS, SLICE = range(4)
#: Added to both branches' counts.
PRIOR = 0.1
#: Weight sets: classes of order 1's count, of the match, and of the depth; inputs per set.
SEEN, MATCHES, DEPTHS, INPUTS = 5, 4, 3, 3
GATES = SEEN * MATCHES * DEPTHS

_BLOBS = "slice string, kind int, bucket int, n long, blobs array<binary>"
_ARROW = pa.schema([("slice", pa.string()), ("kind", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64()), ("blobs", pa.list_(pa.binary()))])


def _press(a: np.ndarray) -> bytes:
    """Zstandard over byte planes."""
    import zstandard

    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes()) if a.size else b""


def _open(blob: bytes, kind: str) -> np.ndarray:
    import zstandard

    width = np.dtype(kind).itemsize
    if not blob:
        return np.zeros(0, kind)
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(width, -1).T).view(kind).ravel()


def _press_counts(n: np.ndarray) -> bytes:
    """Counts in the fewest bytes that hold them; the first byte tells how many."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or int(n.max(initial=0)) < 1 << 8 * w)
    return bytes([width]) + _press(n.astype(f"<u{width}").ravel())


def _open_counts(blob: bytes) -> np.ndarray:
    return _open(blob[1:], f"<u{blob[0]}").astype(np.int64)


def _press_sorted(keys: np.ndarray) -> bytes:
    return _press(np.diff(keys, prepend=np.uint64(0)))


def _open_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(_open(blob, "<u8"), dtype=np.uint64)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and each key's number among them."""
    order = np.argsort(keys)
    put = keys[order]
    new = np.ones(len(put), bool)
    new[1:] = put[1:] != put[:-1]
    numbers = np.empty(len(keys), np.int32)
    numbers[order] = np.cumsum(new, dtype=np.int32) - 1
    return put[new], numbers


def buckets_of(keys: np.ndarray, kind: int, buckets: int) -> np.ndarray:
    """The bucket of each key, a range of keys: those that share the counts along their code share it, and all begin with bits of hashes."""
    shift, bits = {WORDS: (64 - TOP, TOP), CONTEXTS: (HIGH, CONTEXT), PAIRS: (BITS - HIGH, HIGH + CONTEXT)}[kind]
    return ((keys >> np.uint64(shift)) * np.uint64(min(buckets, 1 << TOP)) >> np.uint64(bits)).astype(np.int64)


def contexts_of(pairs: np.ndarray) -> np.ndarray:
    """The key of a context with the first block of a code, of sorted distinct pairs."""
    slot = pairs >> np.uint64(BITS - HIGH)
    return (slot & np.uint64((1 << CONTEXT) - 1)) << np.uint64(HIGH) | slot >> np.uint64(CONTEXT)


class Tokens:
    """A slice: tokens as numbers of distinct words, texts as ranges of tokens."""

    def __init__(self, hashes: np.ndarray, index: np.ndarray, cuts: np.ndarray):
        self.hashes, self.index, self.cuts = hashes, index, cuts
        self.codes = (hashes >> np.uint64(64 - BITS)).astype(np.int32)
        self.text = np.repeat(np.arange(len(cuts) - 1, dtype=np.int32), np.diff(cuts))

    @classmethod
    def of(cls, texts: pa.Array) -> Tokens:
        import xxhash

        words = word_lists(pc.ascii_lower(pc.fill_null(texts, "")))
        coded = words.flatten().dictionary_encode()
        h = np.array([xxhash.xxh64_intdigest(w.encode()) for w in coded.dictionary.to_pylist()] + [xxhash.xxh64_intdigest(b"\n")], np.uint64)  # no word is a line break
        put, back = _distinct(h)
        upto = words.offsets.to_numpy().astype(np.int64)
        index = np.insert(back[coded.indices.to_numpy()], upto[1:], back[-1])
        return cls(put, index.astype(np.int32), upto + np.arange(len(upto)))

    def packed(self) -> list[bytes]:
        """Words by falling count, so that few bytes tell most tokens."""
        order = np.argsort(-np.bincount(self.index, minlength=len(self.hashes)), kind="stable")
        rank = np.empty(len(order), "<u4")
        rank[order] = np.arange(len(order))
        return [_press_sorted(self.hashes), _press(rank), _press(rank[self.index]), _press(self.cuts.astype("<i8"))]

    @classmethod
    def unpacked(cls, blobs: list[bytes]) -> Tokens:
        rank = _open(blobs[1], "<u4")
        word = np.empty(len(rank), np.int32)
        word[rank] = np.arange(len(rank))
        return cls(_open_sorted(blobs[0]), word[_open(blobs[2], "<u4")], _open(blobs[3], "<i8"))

    def before(self, by: int) -> np.ndarray:
        """The token ``by`` places earlier; before a text's first stands the end token."""
        import xxhash

        end = np.int32(np.searchsorted(self.hashes, np.uint64(xxhash.xxh64_intdigest(b"\n"))))
        out = np.full(len(self.index), end, np.int32)
        out[by:] = self.index[:-by] if by < len(self.index) else out[by:]
        for k in range(by):  # a text's first tokens
            first = self.cuts[:-1] + k
            out[first[first < self.cuts[1:]]] = end
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        # the code's first block goes first, so that a context that many texts share lies in many buckets
        key = (self.codes >> (BITS - HIGH) << CONTEXT).astype(np.uint64)[self.index]
        key |= (self.codes >> (BITS - CONTEXT)).astype(np.uint64)[self.before(1)]
        key <<= np.uint64(BITS - HIGH)
        key |= (self.codes & ((1 << BITS - HIGH) - 1)).astype(np.uint64)[self.index]
        return _distinct(key)

    def matched(self) -> tuple[np.ndarray, np.ndarray]:
        """The code that the match predicts for each token, and the match's class (0: none)."""
        predicted, cls = np.zeros(len(self.index), np.int32), np.zeros(len(self.index), np.int8)
        key = self.text.astype(np.int64) * len(self.hashes) + self.before(1)
        for k in (1, 2):
            if k == 2:
                key = key * np.int64(0x9E3779B1) + self.before(2)  # other contexts of one key cost a wrong guess, nothing else
            order = np.argsort(key, kind="stable").astype(np.int32)
            same = key[order[1:]] == key[order[:-1]]
            at, earlier = order[1:][same], order[:-1][same]
            begin = self.cuts[:-1].astype(np.int32)
            ok = (at - begin[self.text[at]] >= k) & (earlier - begin[self.text[earlier]] >= k)
            at, earlier = at[ok], earlier[ok]
            predicted[at], cls[at] = self.codes[self.index[earlier]], k
        right = (cls > 0) & (predicted == self.codes[self.index])
        longer = np.zeros(len(cls), bool)
        longer[1:] = right[:-1] & (self.text[1:] == self.text[:-1])
        return predicted, np.where((cls == 2) & longer, np.int8(3), cls)


def _keys(tokens: Tokens, learn: np.ndarray, kinds: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Kind, sorted distinct keys and their counts among texts to learn from."""
    weight = learn[tokens.text].astype(np.float64)
    if WORDS in kinds:
        yield WORDS, tokens.hashes, np.bincount(tokens.index, weight, len(tokens.hashes)).astype(np.int64)
    if PAIRS not in kinds:
        return
    pairs, number = tokens.pairs()
    n = np.bincount(number, weight, len(pairs)).astype(np.int64)
    yield PAIRS, pairs, n
    contexts, of = _distinct(contexts_of(pairs))
    yield CONTEXTS, contexts, np.bincount(of, n, len(contexts)).astype(np.int64)


def _slices(rows: DataFrame, size: int) -> DataFrame:
    """Rows ``row``, ``learn``, ``t`` as slices: the kept columns, and the tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices(batch, 2, size):
                sink = pa.BufferOutputStream()
                bytes_ = pc.fill_null(pc.binary_length(part.column(2)), 0).cast(pa.int64())
                kept = pa.RecordBatch.from_arrays([part.column(0), part.column(1), bytes_], ["row", "learn", "bytes"])
                with pa.ipc.new_stream(sink, kept.schema) as out:
                    out.write_batch(kept)
                blobs = [sink.getvalue().to_pybytes(), *Tokens.of(part.column(2)).packed()]
                yield _rows([(f"{task}-{k}", SLICE, 0, part.num_rows, blobs)])
                k += 1

    return rows.mapInArrow(run, _BLOBS)


def _rows(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), _ARROW, strict=True)], schema=_ARROW)


def _kept(blobs: list[bytes]) -> pa.RecordBatch:
    return pa.ipc.open_stream(blobs[0]).read_next_batch()


def _dealt(slices_: DataFrame, kinds: tuple[int, ...], buckets: int) -> DataFrame:
    """Blocks of each slice's distinct keys with their counts among the texts to learn from, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                me, blobs = batch.column(0)[i].as_py(), batch.column(4)[i].as_py()
                learn = _kept(blobs).column(1).to_numpy(zero_copy_only=False)
                for kind, keys, n in _keys(Tokens.unpacked(blobs[1:]), learn, kinds):
                    cuts = np.searchsorted(buckets_of(keys, kind, buckets), np.arange(buckets + 1)).tolist()
                    found = [(me, kind, b, v - u, [_press_sorted(keys[u:v]), _press_counts(n[u:v])]) for b, (u, v) in enumerate(zip(cuts, cuts[1:], strict=False)) if u < v]
                    if found:
                        yield _rows(found)

    return slices_.mapInArrow(run, _BLOBS)


#: Steps of log-odds in one unit; a byte holds them.
STEPS = 16
#: Least counts of order 1's classes after the first, which has none.
_LEAST = np.array([1, 2, 4, 16])


_LOGS = STEPS * np.log(np.arange(1 << 16) + PRIOR)


def _log(n: np.ndarray) -> np.ndarray:
    return _LOGS[n] if n.max(initial=0) < len(_LOGS) else STEPS * np.log(n + PRIOR)


def log_odds(node: np.ndarray, branch: np.ndarray) -> np.ndarray:
    """Log-odds of a branch in whole steps. The other branch has exactly the negative, so both sum to one."""
    return np.clip(np.rint(_log(branch) - _log(node - branch)), -127, 127).astype(np.int8)


def _along(keys: np.ndarray, n: np.ndarray, shifts: range) -> list[np.ndarray]:
    """For sorted keys, the counts of all keys that agree above each shift."""
    out = []
    for s in shifts:
        prefix = keys >> np.uint64(s)
        new = np.ones(len(keys), bool)
        new[1:] = prefix[1:] != prefix[:-1]
        out.append(np.add.reduceat(n, np.flatnonzero(new))[np.cumsum(new) - 1])
    return out


def _children(keys: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sorted keys: where each new prefix above a shift begins, each key's number among them, and whether its sibling is next to it."""
    prefix = keys >> np.uint64(shift)
    new = np.ones(len(keys), bool)
    new[1:] = prefix[1:] != prefix[:-1]
    first = np.flatnonzero(new)
    u, paired = prefix[first], np.zeros(len(first), np.int8)
    both = (u[1:] ^ u[:-1]) == 1
    paired[:-1][both] = 1
    paired[1:][both] = -1
    return first, np.cumsum(new) - 1, paired


def _untaken(keys: np.ndarray, counts: list[np.ndarray], shifts: range) -> np.ndarray:
    """Along the codes of sorted keys, the counts of branches that none of the keys takes, level by level; nearly all are 0."""
    out = []
    for k in range(len(shifts) - 1):
        first, _, paired = _children(keys, shifts[k + 1])
        at = first[paired == 0]
        out.append(counts[k][at] - counts[k + 1][at])
    return np.concatenate(out)


def _counts(keys: np.ndarray, last: np.ndarray, untaken: np.ndarray, shifts: range) -> list[np.ndarray]:
    """The counts along the codes, from those of the codes themselves and of the branches that no key takes."""
    counts, end = [last], len(untaken)
    for k in range(len(shifts) - 2, -1, -1):
        first, number, paired = _children(keys, shifts[k + 1])
        own = counts[0][first]
        other, alone = own[np.arange(len(first)) + paired], paired == 0
        begin = end - int(alone.sum())
        other[alone] = untaken[begin:end]
        end = begin
        counts.insert(0, counts[0] + other[number])
    return counts


def _levels(kind: int) -> range:
    """Shifts of keys to the code prefixes that a kind's decisions lead from and to."""
    return range(64 - TOP, 64 - BITS - 1, -1) if kind == WORDS else range(HIGH, -1, -1) if kind == CONTEXTS else range(BITS - HIGH, -1, -1)


def _learned(counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """From counts along codes: log-odds and the class of the node's count, of each decision."""
    odds = np.stack([log_odds(a, b) for a, b in zip(counts, counts[1:], strict=False)])
    return odds, np.stack([np.searchsorted(_LEAST, a, "right").astype(np.uint8) for a in counts[:-1]])


def _exact(keys: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Each word's count, its code's, and how many training words the code has."""
    code = range(64 - BITS, 64 - BITS + 1)
    return [n, _along(keys, n, code)[0], _along(keys, (n > 0).astype(np.int64), code)[0]]


def _tops(cells: np.ndarray, codes: np.ndarray, own: int = 0) -> np.ndarray:
    """Order 0's log-odds of the first TOP decisions, from counts of code prefixes."""
    out, prefix = np.empty((len(codes), TOP), np.int8), codes >> (BITS - TOP)
    for d in range(TOP):
        node, branch = (np.maximum(cells.reshape(1 << k, -1).sum(axis=1) - own, 0) for k in (d, d + 1))
        out[:, d] = log_odds(np.maximum(np.repeat(node, 2), branch), branch)[prefix >> (TOP - d - 1)]
    return out


def _merged(key: tuple, blocks: pa.Table) -> pa.Table:
    """A bucket's counts over all slices; back to each slice the counts of the branches along its keys' codes."""
    kind, bucket = (k.as_py() for k in key)
    names = blocks["slice"].to_pylist()
    sent = [(_open_sorted(b[0]), _open_counts(b[1])) for b in blocks["blobs"].to_pylist()]
    keys, number = _distinct(np.concatenate([k for k, _ in sent]))
    n = np.bincount(number, np.concatenate([c for _, c in sent]), len(keys)).astype(np.int64)
    counts = _along(keys, n, _levels(kind))
    exact = [counts[-1]]
    if kind == WORDS:  # a code's other words and its words but this one are few
        own, code, kinds = _exact(keys, n)
        exact = [own, code - own, np.maximum(kinds - 1, 0)]
    found, at = [], 0
    for name, (k, _) in zip(names, sent, strict=True):
        mine = number[at : at + len(k)]
        at += len(k)
        untaken = _untaken(k, [c[mine] for c in counts], _levels(kind))
        found.append((name, kind, bucket, len(k), [_press_counts(untaken), *[_press_counts(x[mine]) for x in exact]]))
    if kind == WORDS:
        cell = (keys >> np.uint64(64 - TOP)).astype(np.int64)
        cells, where = np.unique(cell, return_inverse=True)
        found.append((None, kind, bucket, int((n > 0).sum()), [_press_counts(cells), _press_counts(np.bincount(where, n).astype(np.int64))]))
    return pa.Table.from_batches([_rows(found)])


_DEPTH = np.minimum(np.arange(BITS) // 8, DEPTHS - 1).astype(np.uint8)


class Predictors:
    """All predictors' inputs for a slice."""

    def __init__(self, tokens: Tokens, zero: np.ndarray, one: np.ndarray, seen: np.ndarray, exact: np.ndarray, pair: np.ndarray):
        """Log-odds of order 0 by word and of order 1 by pair, order 1's classes of counts, exact counts, each token's pair."""
        self.tokens, self.zero, self.one, self.exact, self.pair = tokens, zero, one, exact, pair
        self.seen = seen
        self.seen *= np.uint8(MATCHES * DEPTHS)
        self.seen += _DEPTH
        predicted, self.cls = tokens.matched()
        wrong = np.frexp((predicted ^ tokens.codes[tokens.index]).astype(np.float32))[1]
        self.agree = np.where(self.cls > 0, BITS - wrong, -1).astype(np.int8)

    @classmethod
    def of_slice(cls, tokens: Tokens, got: list[tuple[int, int, list[bytes]]], cells: np.ndarray, own: int = 0) -> Predictors:
        """From what came back: kind, bucket and blobs of the slice's keys. Log-odds and classes are those without ``own`` occurrences of a token."""
        pairs, number = tokens.pairs()
        contexts, of = _distinct(contexts_of(pairs))
        words, exact = len(tokens.hashes), np.zeros((3, len(tokens.hashes)), np.int64)
        zero, one, seen = np.empty((words, BITS), np.int8), np.empty((len(pairs), BITS), np.int8), np.empty((len(pairs), BITS), np.uint8)
        zero[:, :TOP] = _tops(cells, tokens.codes, own)
        high = [np.empty((len(contexts), HIGH), t) for t in (np.int8, np.uint8)]
        into = {WORDS: (zero[:, TOP:], None), CONTEXTS: tuple(high), PAIRS: (one[:, HIGH:], seen[:, HIGH:])}
        for kind, keys in {WORDS: tokens.hashes, CONTEXTS: contexts, PAIRS: pairs}.items():
            at = 0  # buckets are ranges, so blocks in order hold all keys in order
            for _, _, blobs in sorted((x for x in got if x[0] == kind), key=lambda x: x[1]):
                untaken, *more = map(_open_counts, blobs)
                mine = slice(at, at + len(more[0]))
                at = mine.stop
                counts = _counts(keys[mine], more[0] + more[1] if kind == WORDS else more[0], untaken, _levels(kind))
                odds, classes = _learned([np.maximum(c - own, 0) for c in counts])
                into[kind][0][mine] = odds.T
                if kind == WORDS:
                    exact[:, mine] = more[0], counts[-1], more[2] + (counts[-1] > 0)
                else:
                    into[kind][1][mine] = classes.T
        one[:, :HIGH], seen[:, :HIGH] = (x[of] for x in high)
        return cls(tokens, zero, one, seen, exact, number)

    def decisions(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Steps of log-odds of orders 0 and 1, the match's vote and gates, arrays ``(tokens, BITS)``, for tokens ``at``."""
        pair = self.pair[at]
        d, agree = np.arange(BITS, dtype=np.int8), self.agree[at][:, None]
        active = d <= agree
        match = active.astype(np.float32)
        match[d == agree] = -1
        gate = self.seen[pair] + active * (self.cls[at] * np.uint8(DEPTHS)).astype(np.uint8)[:, None]
        return self.zero[self.tokens.index[at]], self.one[pair], match, gate

    def inputs(self, at: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Log-odds of the branches taken, an array ``(tokens, BITS)`` per input, and gates, for tokens ``at``.

        Log-odds of the other branch are the negatives; gates depend on what is known before the decision.
        """
        zero, one, match, gate = self.decisions(at)
        return [zero * np.float32(1 / STEPS), one * np.float32(1 / STEPS), match], gate

    def within_code(self) -> np.ndarray:
        """Natural log of each token's probability among those of its code."""
        n, code, kinds = self.exact
        return np.log((n + PRIOR) / (code + PRIOR * (kinds + 1)))[self.tokens.index]


#: Levels of a log-odds in tallies, half a unit apart, and the level of each byte.
LEVELS = 33
_LEVEL = (np.rint(np.arange(256).astype(np.uint8).view(np.int8) / (STEPS / 2)) + LEVELS // 2).astype(np.int32)


def tallied(p: Predictors, learn: np.ndarray, together: int = 1 << 15) -> np.ndarray:
    """How many decisions of the texts to learn from have each gate (a row), vote of the match, and level of orders 1 and 0."""
    out = np.zeros(GATES * 3 * LEVELS**2, np.int64)
    at = np.flatnonzero(learn[p.tokens.text])
    for i in range(0, len(at), together):
        zero, one, match, gate = p.decisions(at[i : i + together])
        cell = gate.astype(np.int32) * 3 + match.astype(np.int32) + 1
        cell = (cell * LEVELS + _LEVEL[one.view(np.uint8)]) * LEVELS + _LEVEL[zero.view(np.uint8)]
        out += np.bincount(cell.ravel(), minlength=len(out))
    return out.reshape(GATES, -1)


def fitted(tally: np.ndarray, rounds: int = 8, ridge: float = 20.0) -> np.ndarray:
    """A gate's weights by Newton's method; ``ridge`` draws those of rare gates to a plain mix."""
    there = np.flatnonzero(tally)
    n, x = tally[there], np.stack([there % LEVELS - LEVELS // 2, there // LEVELS % LEVELS - LEVELS // 2, 2 * (there // LEVELS**2 - 1)]) / 2
    plain = np.array([0.5, 0.5, 1.0])
    w = plain
    for _ in range(rounds):
        q = 1 / (1 + np.exp(np.clip(w @ x, -15, 15)))  # of the branch not taken
        g = x @ (n * q) - ridge * (w - plain)
        w = w + np.clip(np.linalg.solve((x * (n * q * (1 - q))) @ x.T + ridge * np.eye(INPUTS), g), -1, 1)
    return w


#: Decisions with errors below this teach nothing.
LEAST_ERROR = 1 / 64


def mixed(p: Predictors, start: np.ndarray, rate: float = 0.5, trust: float = 20.0, together: int = 256) -> np.ndarray:
    """Natural log probability of each text, its weights refined after each block of tokens.

    Texts are taken side by side, longest first, a block of each at a time; ``together`` bounds what is held at once.
    """
    cuts = p.tokens.cuts
    lengths = np.diff(cuts)
    order = np.argsort(-lengths, kind="stable")
    sizes, total = lengths[order], np.zeros(len(lengths))
    for a in range(0, len(lengths), together):
        b = min(len(lengths), a + together)
        w = [np.tile(v.astype(np.float32), b - a) for v in start]
        learned = np.zeros((b - a) * GATES)
        for begin in range(0, int(sizes[a]), BLOCK):
            alive = int(np.searchsorted(-sizes[a:b], -begin, "left"))
            n = np.minimum(sizes[a : a + alive] - begin, BLOCK)
            here, ends = np.repeat(np.arange(alive), n), np.cumsum(n)
            at = np.repeat(cuts[order[a : a + alive]] + begin - (ends - n), n) + np.arange(int(ends[-1]))
            x, gate = p.inputs(at)
            flat = (here * GATES)[:, None] + gate
            z = np.take(w[0], flat, mode="clip") * x[0]
            for i in range(1, INPUTS):
                z += np.take(w[i], flat, mode="clip") * x[i]
            e = np.exp(-np.clip(z, -15, 15, out=z))
            e1 = 1 + e
            # the product of a token's decisions stays below exp(15 * BITS), which a double holds
            total[a : a + alive] += np.bincount(here, -np.log(np.multiply.reduce(e1, axis=1, dtype=np.float64)), alive)
            if sizes[a] > begin + BLOCK:
                err = np.divide(e, e1, out=e).ravel()
                teach = np.flatnonzero(err > LEAST_ERROR)
                to, err, size = flat.ravel()[teach], err[teach], alive * GATES
                learned[:size] += np.bincount(to, minlength=size)
                pace = rate / (learned[:size] + trust)
                for i in range(INPUTS):
                    w[i][:size] += np.bincount(to, err * x[i].ravel()[teach], size) * pace
    out = np.empty(len(lengths))
    out[order] = total
    return out + np.bincount(p.tokens.text, p.within_code(), len(lengths))


def scores(docs: DataFrame, id: str = "doc_id", text: str = "text", keep: list[str] | None = None, slice_bytes: int = 14_500_000, rate: float = 0.5) -> DataFrame:
    """``row`` (the kept columns, all by default), ``held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte``.

    Scores are log10 probabilities; ``base_score`` is that of smoothed training counts. Counts and starting weights come from
    all training texts.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 10 == 0, F.lit(False))
    rows = docs.select(F.struct(F.struct(*(keep or ["*"])).alias("row"), held.alias("held_out")).alias("row"), (~held).alias("learn"), F.col(text).alias("t"))
    kind = f"row {rows.schema['row'].dataType['row'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    all_, bytes_ = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    if not all_:
        return spark.createDataFrame([], kind)
    buckets = int(min(2048, max(8, -(-bytes_ // 24_000_000))))

    # bucketed by slice, so that the slices themselves need not be shuffled when their counts come back
    name = f"slices_{uuid.uuid4().hex}"
    _slices(rows, slice_bytes).write.bucketBy(3 * buckets, "slice").option("path", scratch_path(spark, "slices")).saveAsTable(name)
    whole = spark.table(name)
    words = written(_dealt(whole, (WORDS,), buckets).groupBy("kind", "bucket").applyInArrow(_merged, _BLOBS), "words")
    cells, kinds = np.zeros(1 << TOP, np.int64), 0
    for r in words.where("slice is null").select("n", "blobs").toLocalIterator():
        cells[_open_counts(bytes(r.blobs[0]))] += _open_counts(bytes(r.blobs[1]))
        kinds += r.n
    trained = int(cells.sum())
    others = _dealt(whole, (CONTEXTS, PAIRS), buckets).groupBy("kind", "bucket").applyInArrow(_merged, _BLOBS)

    def predictors(one: pa.Table, counted: pa.Table, own: int) -> tuple[pa.RecordBatch, Predictors]:
        blobs = one["blobs"][0].as_py()
        got = list(zip(counted["kind"].to_pylist(), counted["bucket"].to_pylist(), counted["blobs"].to_pylist(), strict=True))
        return _kept(blobs), Predictors.of_slice(Tokens.unpacked(blobs[1:]), got, cells, own)

    def tally(key: tuple, one: pa.Table, counted: pa.Table) -> pa.Table:
        kept, p = predictors(one, counted, 1)
        found = tallied(p, kept.column(1).to_numpy(zero_copy_only=False))
        return pa.table({"gate": np.arange(GATES, dtype=np.int32), "n": [_press_counts(n) for n in found]})

    def fit(key: tuple, tallies: pa.Table) -> pa.Table:
        return pa.table({"gate": pa.array([key[0].as_py()], pa.int32()), "w": [fitted(sum(_open_counts(n) for n in tallies["n"].to_pylist()))]})

    def score(key: tuple, one: pa.Table, counted: pa.Table) -> pa.Table:
        kept, p = predictors(one, counted, 0)
        tokens, start = p.tokens, np.array(one["start"][0].as_py()).T
        c, texts = p.exact[0][tokens.index], len(tokens.cuts) - 1
        base = np.bincount(tokens.text, np.log10((c + PRIOR) / (trained + PRIOR * (kinds + 1))), texts)
        found = mixed(p, start, rate) / np.log(10)
        size = kept.column(2).to_numpy()
        bits = np.divide(-found * np.log2(10), size, out=np.zeros(texts), where=size > 0)
        row = kept.column(0)
        return pa.table({
            "row": row.field("row"), "held_out": row.field("held_out"), "n_tokens": np.diff(tokens.cuts), "n_known": np.bincount(tokens.text, c > 0, texts).astype(np.int64),
            "train_tokens": np.full(texts, trained), "base_score": base, "score": found, "bits_per_byte": pa.array(bits, mask=size == 0),
        })

    counted = words.where("slice is not null").unionByName(others)
    tallies = whole.groupBy("slice").cogroup(counted.groupBy("slice")).applyInArrow(tally, "gate int, n binary")
    fits = tallies.groupBy("gate").applyInArrow(fit, "gate int, w array<double>")
    start = fits.agg(F.sort_array(F.collect_list(F.struct("gate", "w"))).getField("w").alias("start"))
    # one query, so that the counts' shuffle serves both
    return whole.crossJoin(F.broadcast(start)).groupBy("slice").cogroup(counted.groupBy("slice")).applyInArrow(score, kind)

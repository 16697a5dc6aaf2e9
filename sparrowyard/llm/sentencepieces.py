"""SentencePiece encoding and decoding with a distinct-chunk table.

A text is marked as the library marks it (a marker in front, a marker for each space) and cut before every
run of markers. Where no piece of the model has a marker after another character, no merge crosses such a
cut, so each distinct chunk is segmented once and its ids are joined back by position. The model is checked
for that, and for a marking of this plain kind, by ``check_model``; a model that fails is refused.

No shuffle: each batch of rows is encoded where it lies, texts whole. Defined results: null and empty
texts give the end id alone and decode to ``""``; repeated rows are encoded alike; an empty table stays
empty. ``encode`` keeps all columns of its input in struct ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparrowyard.llm.chunks import ChunkTable, slices

MARK = "▁"
_loaded: dict[str, tuple] = {}


def check_model(sp) -> None:
    """Raise ValueError unless chunks between whitespace markers are independent under this model."""
    for i in range(sp.get_piece_size()):
        if MARK in sp.id_to_piece(i).lstrip(MARK):
            raise ValueError(f"piece {i} reaches across a whitespace marker")
    plain, word = sp.encode("a b"), sp.encode("  a　b  ", out_type=str)
    if sp.encode(f"a{MARK}b") != plain or "".join(word) != f"{MARK * 3}a　b{MARK * 2}":
        raise ValueError("the model's normalizer does more than mark spaces")


class PieceTable(ChunkTable):
    """Ids and decoded text of each distinct chunk."""

    def __init__(self, sp):
        self.sp, self.end = sp, sp.eos_id()
        self.lead, self.bare = sp.piece_to_id("a"), [sp.piece_to_id(MARK)]
        super().__init__(self._segment)

    def clear(self) -> None:
        super().clear()
        self.decoded = pa.array([], pa.string())

    def _segment(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # the library puts the first marker back; a lone marker would be an empty text to it
        found = self.sp.encode([c[1:] for c in chunks], num_threads=1)
        ids = [self.bare if c == MARK else x for c, x in zip(chunks, found, strict=True)]
        texts = [x[1:] for x in self.sp.decode([[self.lead, *i] for i in ids], num_threads=1)]
        self.decoded = pa.concat_arrays([self.decoded, pa.array(texts, pa.string())])
        return np.array([i for x in ids for i in x], np.int32), np.array([len(x) for x in ids], np.int64)


def _table(path: str) -> PieceTable:
    if path not in _loaded:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        check_model(sp)
        _loaded[path] = PieceTable(sp)
    return _loaded[path]


def marked_chunks(texts: pa.Array) -> pa.ListArray:
    """The chunks of each text, an empty one first; each other one begins with a run of markers."""
    texts = pc.fill_null(texts, "")
    cut = next(c for c in map(chr, range(0xE000, 0xF8FF)) if not pc.any(pc.match_substring(texts, c)).as_py())
    marked = pc.replace_substring(pc.binary_join_element_wise(MARK, texts, ""), " ", MARK)
    # a cut before each marker, then none within a run of them
    return pc.split_pattern(pc.replace_substring(pc.replace_substring(marked, MARK, cut + MARK), MARK + cut, MARK), cut)


def encode_batch(texts: pa.Array, path: str) -> tuple[pa.Array, pa.Array]:
    """Lists of ids, each with the end id last, and the decoded texts."""
    table, chunks = _table(path), marked_chunks(texts)
    cuts = chunks.offsets.to_numpy() - chunks.offsets[0].as_py()
    d = chunks.flatten().dictionary_encode()
    # without text there is a marker of no word, and the library gives it no id
    empty = pc.equal(pc.fill_null(texts, ""), "").to_numpy(zero_copy_only=False)
    numbers = table.numbered(d.dictionary.to_pylist(), distinct=True)[d.indices.to_numpy()] if len(d) else np.zeros(0, np.int64)
    ids, n = table.ids(numbers)
    words = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), table.decoded.take(pa.array(numbers))), "")
    decoded = pc.utf8_slice_codeunits(words, 1)
    if empty.any():
        keep = np.repeat(~empty, np.diff(cuts))
        ids, n = ids[np.repeat(keep, n)], np.where(keep, n, 0)
    upto = np.concatenate([[0], np.cumsum(n)])[cuts]
    ids, offsets = np.insert(ids, upto[1:], table.end), upto + np.arange(len(cuts))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())), decoded


def encode(docs: DataFrame, model: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (columns ``keep`` of the input, all by default), ``ids`` and ``decoded`` per document."""
    packed = docs.select(F.struct(*(keep or docs.columns)).alias("row"), F.col(text).alias("t"))
    schema = packed.select("row").schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 4_000_000):
                ids, decoded = encode_batch(part.column(1), model)
                yield pa.RecordBatch.from_arrays([part.column(0), ids, decoded], ["row", "ids", "decoded"])

    return packed.mapInArrow(run, schema)

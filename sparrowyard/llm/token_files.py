"""Token-id files: independent zstandard frames, a trailing seek table, a checksum in every frame.

Layout of a file, all integers little-endian: the frames, one per document (its ids as unsigned 32-bit
integers); then the seek table, itself a frame, with five unsigned 64-bit integers per document (1 if it has
an id, the id, first byte, length in bytes, count of ids); then a footer of 28 bytes: first byte and length of
the seek table, count of documents, and the magic ``TOKF``. A reader fetches the footer, the seek table and
only the frames that it wants; zstandard's content checksum guards each frame.

Documents are range-partitioned by id, and by a hash of the text among equal ids, so that each task encodes
and writes one file, and a third of all rows with one id (or none) are many files. A file's name has a fresh
token: a task that is run again writes another file, and only files of tasks that succeeded are in the manifest.

Defined results: ids are of an integer type, others raise TypeError; null ids come first, each with a frame of
its own, and are read back as null; null and empty texts have the end id alone; rows that repeat an id follow
each other; an empty table gives no files and an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparrowyard.llm.chunks import ChunkTable, joined, slices
from sparrowyard.llm.common import integer_id, qualified, written

MAGIC = b"TOKF"
_FOOTER = "<QQQ4s"
_loaded: dict[str, ChunkTable] = {}

# Printable ASCII and Latin letters, where lower case and letter classes are beyond doubt, in lines.
_PLAIN = re.compile("[\n!-~À-ÖØ-öø-įı-ſ]*")
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|\n|[^\na-z0-9ß-öø-ſ]+")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, others from 256 on in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else spare))
        spare += b not in plain
    return out


def _known(rules: dict) -> bool:
    """Whether the tokenizer has the rules by which ``_table`` cuts plain chunks."""
    steps = [n["type"] for n in (rules["normalizer"] or {}).get("normalizers", [])]
    cuts = (rules["pre_tokenizer"] or {}).get("pretokenizers", [])
    pattern = cuts[0].get("pattern", {}).get("Regex") if cuts else None
    model = rules["model"]
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    return steps == ["NFC", "Replace", "Lowercase"] and pattern == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" and plain and model.get("end_of_word_suffix") == "</w>"


def _table(path: str) -> ChunkTable:
    """BPE of this tokenizer never crosses white space, and so neither do its added tokens.

    Plain chunks are lower-cased and cut here as the tokenizer's own rules do, and their distinct pieces go to
    the library's BPE model, many at a time; the last id of each piece is known by its word end. Any other chunk,
    and any chunk that may hold an added token, goes through the whole library pipeline. A tokenizer with other
    rules uses the pipeline for every chunk.
    """
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        whole = Tokenizer.from_file(path)
        rules = json.loads(whole.to_str())
        special = re.compile("|".join(re.escape(a["content"]) for a in rules["added_tokens"]) or "(?!)").search

        def by_library(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
            ids = [e.ids for e in whole.encode_batch_fast(chunks, add_special_tokens=False)]
            return np.array([i for x in ids for i in x], np.int32), np.array([len(x) for x in ids], np.int64)

        if not _known(rules):
            _loaded[path] = ChunkTable(by_library)
            return _loaded[path]

        letters, model = _byte_letters(), rules["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        bare = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix="</w>", cache_capacity=0))
        bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        last = np.zeros(max(model["vocab"].values()) + 1, bool)
        last[[i for t, i in model["vocab"].items() if t.endswith("</w>")]] = True

        def by_model(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
            text = " ".join([x if x.isascii() else "".join([letters[b] for b in x.encode()]) for x in pieces if x != "\n"])
            ids = np.array(bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
            ends = np.flatnonzero(last[ids]) + 1
            lengths = np.diff(np.concatenate([[0], ends]))
            breaks = [i for i, x in enumerate(pieces) if x == "\n"]
            if len(lengths) + len(breaks) != len(pieces):
                raise ValueError("the model does not end each word by a word end")
            return ids, np.insert(lengths, breaks, 0) if breaks else lengths

        pieces = ChunkTable(by_model, limit=300_000)

        def encode(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
            text = "\n".join(chunks)
            if not _PLAIN.fullmatch(text) or special(text):
                plain = np.array([bool(_PLAIN.fullmatch(c)) and not special(c) for c in chunks])
                if not plain.any():
                    return by_library(chunks)
                if not plain.all():
                    parts = [encode([c for c, p in zip(chunks, plain, strict=True) if p == kind]) for kind in (True, False)]
                    order = np.argsort(np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)]))
                    flat, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                    at = np.cumsum(n) - n
                    return np.concatenate([flat[a : a + k] for a, k in zip(at[order], n[order], strict=True)]), n[order]
            found = _PIECE.findall(text.lower())
            numbers = pieces.numbered(found)
            flat, n = pieces.ids(numbers)
            chunk = np.cumsum(np.fromiter(map("\n".__eq__, found), bool, len(found)))
            return flat, np.bincount(chunk, weights=n, minlength=len(chunks)).astype(np.int64)

        _loaded[path] = ChunkTable(encode)
    return _loaded[path]


def _store(uri: str):
    """File system and path of a qualified URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def encoded(texts: pa.Array, tokenizer: str, end: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts, each closed by the end id, and where each text begins, one more for the end."""
    return joined(pc.ascii_split_whitespace(pc.fill_null(texts, "")), _table(tokenizer), end)


def write(docs: DataFrame, to: str, tokenizer: str, end: int, id: str = "doc_id", text: str = "text", rows_per_file: int = 8000) -> DataFrame:
    """Write the ids of all documents in ascending id order; the manifest: a written table with a row a file.

    Its columns are ``path``, ``docs`` and ``ids`` of the file, ``i`` (its place, from 0) and ``before`` (ids of all files before it).
    """
    integer_id(docs, id)
    to = qualified(docs.sparkSession, to)
    rows = docs.select(F.col(id).cast("long").alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    dealt = rows.repartitionByRange(max(1, -(-docs.count() // rows_per_file)), "id", "h").sortWithinPartitions("id", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1, write_checksum=True, write_content_size=True)
        store, root = _store(to)
        out, index, at, path, first = None, [], 0, "", None
        for batch in batches:
            for part in slices(batch, 2):
                if not out:
                    first = [batch.column(j)[0].as_py() for j in range(2)]
                    store.create_dir(root, recursive=True)
                    path = f"{root}/ids-{uuid.uuid4().hex}.tokf"
                    out = store.open_output_stream(path)
                ids, cuts = encoded(part.column(2), tokenizer, end)
                raw = memoryview(ids.astype("<u4").tobytes())
                frames = [press.compress(raw[4 * a : 4 * b]) for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]
                out.write(b"".join(frames))
                lengths = np.fromiter(map(len, frames), np.int64, len(frames))
                has = part.column(0).is_valid().to_numpy(zero_copy_only=False)
                keys = pc.fill_null(part.column(0), 0).to_numpy()
                index.append(np.stack([has, keys, at + np.cumsum(lengths) - lengths, lengths, np.diff(cuts)], axis=1).astype("<i8"))
                at += int(lengths.sum())
        if out:
            table = np.concatenate(index)
            packed = press.compress(table.tobytes())
            out.write(packed)
            out.write(struct.pack(_FOOTER, at, len(packed), len(table), MAGIC))
            out.close()
            row = {"id": first[0], "h": first[1], "path": path, "docs": len(table), "ids": int(table[:, 4].sum())}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("id", pa.int64()), ("h", pa.int64()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

    files = written(dealt.mapInArrow(run, "id long, h long, path string, docs long, ids long"), "files")
    return written(_placed(files), "manifest")


def _placed(files: DataFrame) -> DataFrame:
    """Files in order of their first rows with ``i`` and ``before``, by range partitions, of which sums are added up in one place."""
    order = ["id", "h"]
    dealt = written(files.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "files")
    parts = dealt.groupBy("part").agg(F.count("*").alias("n"), F.sum("ids").alias("s"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    zero = F.lit(0).cast("long")
    offsets = parts.select("part", F.coalesce(F.sum("n").over(ahead), zero).alias("n0"), F.coalesce(F.sum("s").over(ahead), zero).alias("s0"))
    within = Window.partitionBy("part").orderBy(*order)
    earlier = F.coalesce(F.sum("ids").over(within.rowsBetween(Window.unboundedPreceding, -1)), zero)
    numbered = dealt.withColumn("k", F.row_number().over(within) - 1).withColumn("earlier", earlier)
    return numbered.join(offsets, "part").select("path", "docs", "ids", (F.col("n0") + F.col("k")).alias("i"), (F.col("s0") + F.col("earlier")).alias("before"))


def read_index(store, path: str) -> np.ndarray:
    """Rows of 1 for an id or 0 for none, id, first byte, length and count of ids."""
    import zstandard

    size = store.get_file_info(path).size
    with store.open_input_file(path) as f:
        at, length, n, magic = struct.unpack(_FOOTER, f.read_at(28, size - 28))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token-id file")
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(f.read_at(length, at)), "<i8").reshape(n, 5)


def read_ids(spark: SparkSession, to: str, path: str, wanted: set[int]) -> dict[int, np.ndarray]:
    """Ids of the wanted documents of a file; only their frames are read. Of rows that repeat an id, the last."""
    import zstandard

    store, _ = _store(qualified(spark, to))
    with store.open_input_file(path) as f:
        return {int(i): np.frombuffer(zstandard.ZstdDecompressor().decompress(f.read_at(int(n), int(a))), "<u4") for has, i, a, n, _ in read_index(store, path) if has and int(i) in wanted}


def read(spark: SparkSession, to: str, manifest: DataFrame) -> DataFrame:
    """All documents from the files: ``doc_id``, ``start`` (ids before it), ``n_tokens``, ``ids`` (little-endian bytes)."""
    to = qualified(spark, to)
    files = manifest.select(F.col("i").cast("int").alias("i"), "path", "before")
    files = files.repartitionById(max(1, manifest.count()), "i")  # a file a task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        store, _ = _store(to)
        for batch in batches:
            for path, start in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                index = read_index(store, path)
                starts = start + np.cumsum(index[:, 4]) - index[:, 4]
                with store.open_input_file(path) as f:
                    for a in range(0, len(index), 256):
                        part = index[a : a + 256]
                        first, size = int(part[0, 2]), int(part[-1, 2] + part[-1, 3] - part[0, 2])
                        block, open_ = memoryview(f.read_at(size, first)), zstandard.ZstdDecompressor()
                        ids = [open_.decompress(block[x - first : x - first + n]) for x, n in part[:, 2:4].tolist()]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(part[:, 1].copy(), mask=part[:, 0] == 0), pa.array(starts[a : a + 256]), pa.array(part[:, 4].copy()), pa.array(ids, pa.binary())],
                            ["doc_id", "start", "n_tokens", "ids"],
                        )

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")

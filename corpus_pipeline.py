"""From raw documents to token ids: quality rules, near-duplicates, personal data, mixing, SentencePiece.

Every stage works on all rows that the stage before kept, and its result is written as Parquet in the shared
folder and read again, so a lost executor costs one stage's tasks at most. All stages but the last return
the columns of ``documents``. Nulls, empty texts, repeated rows and extra columns are handled as the
operators' docstrings define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowyard.llm import mixing, pii, quality, sentencepieces, similar
from sparrowyard.llm.common import scratch_path
from sparrowyard.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without their failing lines."""
    return quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of texts that five-word shingles find similar by 0.8 or more."""
    return similar.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind."""
    return pii.redacted(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and the decoded text's checksum for each row of the mix."""
    found = sentencepieces.encode(docs, tokenizer_path("piece_bpe_32k.model"), keep=["doc_id", "source", "lang"])
    return found.select("row.doc_id", "row.source", "row.lang", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", mixing_sources),
    ("SentencePiece encoding and decoding", sentencepiece_ids),
]

#: SQL expresses neither Hamming components nor the library's segmentation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage-{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

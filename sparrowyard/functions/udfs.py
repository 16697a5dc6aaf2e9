"""Python functions for what users bring themselves: scorers and decoders. They run over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _initials(text: str | None) -> str | None:
    return None if text is None else "".join(w[0].upper() for w in text.split())


def register_udfs(spark: SparkSession) -> None:
    """``initials(text)`` for SQL; ``columns.initials`` is its native twin and the faster one."""
    spark.udf.register("initials", _initials, "string")


def make_classifier(load: Callable[[], Callable[[list[str]], list[tuple[str, float]]]]):
    """A column function to ``name|confidence``; ``load`` runs once a task and gives the scorer of a batch.

    An empty or null text is ``Others|0.0`` and never reaches the scorer.
    """

    @F.pandas_udf("string")
    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = load()
        for texts in batches:
            full = texts.fillna("").str.strip() != ""
            out = pd.Series("Others|0.0", index=texts.index)
            if full.any():
                out[full] = [f"{name}|{confidence}" for name, confidence in scorer(texts[full].tolist())]
            yield out

    return classify


def make_decoder(decode: Callable[[bytes], bytes], fallback: bytes):
    """A column function from bytes to bytes; what the decoder refuses becomes the fallback. Repartition before it."""

    def one(blob) -> bytes:
        try:
            return decode(bytes(blob))
        except Exception:
            return fallback

    @F.pandas_udf("binary")
    def run(blobs: pd.Series) -> pd.Series:
        return blobs.map(one)

    return run

"""Column expressions: every function takes and returns columns, so Catalyst sees plain built-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cents(amount: Column) -> Column:
    """Money as exact integer cents, halves rounded up."""
    return F.round(amount.cast("decimal(38,10)") * 100, 0).cast("bigint")


def short_sha1(*cols: Column, n: int = 16, sep: str = "|") -> Column:
    return F.substring(F.sha1(F.concat_ws(sep, *cols).cast("binary")), 1, n)


def event_millis(base: int, idx: Column, tx_id: Column) -> Column:
    """Event time in ms: 10 ms a row from ``base``, plus a jitter below 300 ms that the id decides."""
    jitter = F.pmod(F.conv(F.substring(tx_id, 1, 8), 16, 10).cast("bigint"), F.lit(300))
    return F.lit(base) + idx * 10 + jitter


def risk_index(temp: Column, humidity: Column, co2: Column, alert: Column) -> Column:
    """100 on an alert at the edge; else each reading past its threshold adds its weight."""
    over = lambda c, weight: F.greatest(c, F.lit(0.0)) * weight
    return F.when(alert, 100.0).otherwise(over(temp - 30, 4.0) + over(40 - humidity, 1.5) + over(co2 - 450, 0.1))


def risk_class(index: Column, alert: Column, probable: float, imminent: float) -> Column:
    return F.when(alert | (index >= imminent), "high").when(index >= probable, "medium").otherwise("none")


def clean_text(title: Column, comment: Column, parsed: Column, namespace: Column) -> Column:
    """One readable text per edit: entity pages by their comment without tags, files and categories by name."""
    plain = F.regexp_replace(parsed, "<[^>]+>", "")
    named = F.regexp_replace(title, "^(File|Category|Categoria):", "")
    text = F.when(title.rlike(r"^Q\d+") & (F.length(comment) > 0), plain).when(namespace.isin(6, 14), named).otherwise(title)
    linked = F.regexp_replace(text, r"\[\[(.*\|)?([^\]]+)\]\]", "$2")
    return F.trim(F.regexp_replace(linked, r"/\*.*?\*/", ""))


def split_label(label: Column) -> Column:
    """``name|confidence`` as a struct."""
    parts = F.split(label, r"\|")
    return F.struct(F.get(parts, F.lit(0)).alias("category"), F.get(parts, F.lit(1)).try_cast("double").alias("confidence"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def near(a: Column, b: Column, eps: float = 1e-6) -> Column:
    return F.abs(a - b) < eps


def initials(text: Column) -> Column:
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.upper(F.substring(w, 1, 1))), "")

"""Which text columns hold dates, and in which patterns, from the shapes of all values in one scan.

A value's **shape** has 9 for a digit, B for a month's name and P for AM or PM. Values of a date's shape are counted per
column and shape with the range of their first three parts; all others are counted together, so what is grouped is small
whatever the text. Patterns follow from shape and ranges: four digits are a year; of two small parts the one that goes beyond 12
is the day; where both do, some values have the day first and some the month, and both patterns are given; where neither does,
the month comes first.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MONTH = "(?i)(?<![a-z])(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)(?![a-z])"
_SHAPE = r"^(9{1,2}|9{4}|B{3,9})([-/. ])(9{1,2}|B{3,9})(,? |[-/.])(9{4}|9{1,2})(?:([T ])9{1,2}:99(:99(?:\.9{1,9})?)?( ?P)?(Z|[+-]99:?99)?)?$"


def shape_of(text: Column) -> Column:
    """A value's shape; month names keep their length up to three letters or more."""
    s = F.regexp_replace(F.trim(text), "[0-9]", "9")
    s = F.regexp_replace(s, "(?i)(?<![a-z])(?:am|pm)$", "P")
    return F.regexp_replace(s, _MONTH, "BBB")


def _patterns(shape: str, tops: list[int | None]) -> list[str]:
    """Patterns of a shape whose numeric parts reach ``tops``; none if the parts make no date."""
    m = re.match(_SHAPE, shape)
    if not m:
        return []
    parts = [m[1], m[3], m[5]]
    named = [k for k, p in enumerate(parts) if p[0] == "B"]
    if len(named) > 1:
        return []
    year = "yyyy" if "9999" in (m[1], m[5]) else "yy"
    at = 0 if m[1] == "9999" else 2
    if at == 0 and m[5] == "9999":
        return []
    small = [k for k in range(3) if k != at]
    if any(tops[k] is not None and (tops[k] > 31 or tops[k] < 1) for k in small):
        return []
    month = "MMM" if named else "M"
    if named:
        orders = [(named[0], next(k for k in small if k != named[0]))] if named[0] in small else []
    else:
        first, second = (tops[k] > 12 for k in small)
        orders = [(small[0], small[1]), (small[1], small[0])] if first and second else [(small[1], small[0])] if first else [(small[0], small[1])]
    time = ""
    if m[6]:
        hour = "h" if m[8] else "H"
        fraction = (m[7] or "").partition(".")[2]
        time = ("'T'" if m[6] == "T" else " ") + f"{hour}:mm" + (":ss" if m[7] else "") + ("." + "S" * len(fraction) if fraction else "") + (m[8] or "").replace("P", "a") + ("XXX" if m[9] and (m[9] == "Z" or ":" in m[9]) else "XX" if m[9] else "")
    out = []
    for month_at, day_at in orders:
        role = {at: year, month_at: month, day_at: "d"}
        out.append(f"{role[0]}{m[2]}{role[1]}{m[4]}{role[2]}{time}")
    return out


def date_formats(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """``column, pattern, n``: the patterns of each text column, and of how many values; values of no date's shape have a null pattern.

    Where a shape has two patterns, ``n`` is that of the shape for both. Nulls do not count; a column of nulls has no row. The driver sees a row for
    each column and shape.
    """
    names = [c for c, kind in df.dtypes if kind == "string"] if columns is None else list(columns)
    if not names:
        return df.sparkSession.createDataFrame([], "column string, pattern string, n long")
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in names])).alias("x")).select("x.*").where("v is not null")
    shape = shape_of(F.col("v"))
    parts = F.regexp_extract_all(F.trim("v"), F.lit("([0-9]+|[A-Za-z]+)"))
    shaped = cells.select("column", F.when(shape.rlike(_SHAPE), shape).alias("shape"), parts.alias("parts"))
    tops = [F.max(F.get("parts", F.lit(k)).try_cast("int")).alias(f"top{k}") for k in range(3)]
    rows = []
    for r in shaped.groupBy("column", "shape").agg(F.count("*").alias("n"), *tops).collect():
        found = _patterns(r.shape, [r.top0, r.top1, r.top2]) if r.shape else []
        rows += [(r.column, p, r.n) for p in found or [None]]
    made = df.sparkSession.createDataFrame(rows, "column string, pattern string, n long")
    return made.groupBy("column", "pattern").agg(F.sum("n").alias("n"))


def parsed(text: Column, patterns: Iterable[str]) -> Column:
    """The time of a text by the first pattern that reads it; null by none."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(p)) for p in patterns])

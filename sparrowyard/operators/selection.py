"""Exact order statistics of groups of any size by narrowing ranges of values; no group's values meet in one task.

Each wanted place of a group has a range of values that holds it, and the count of values below the range. A
round takes a quantile sketch of the values in range (partial sketches of fixed size, merged), picks the two of its 512
cuts around the place with a margin far beyond the sketch's error, and counts exactly what lies below and within; so a
range keeps about a hundredth of its values each round. Ranges of at most ``ordered`` values are ordered at the end.
Two scans a round: a billion values take two rounds.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowyard.session import shared_dir

#: Values of a group that one task orders at most.
ORDERED = 1_000_000
_CUTS, _MARGIN = 512, 2


class NotNarrowed(RuntimeError):
    """A range still held too many values after all rounds."""


def _cut(df: DataFrame) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/selection-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def largest(df: DataFrame, keys: list[str], col: str) -> int:
    """Values of the largest group."""
    return df.groupBy(*keys).agg(F.count(col).alias("n")).agg(F.max("n")).first()[0] or 0


def order_statistics(df: DataFrame, keys: list[str], col: str, ranks: dict[str, Callable[[Column], Column]], ordered: int = ORDERED, rounds: int = 20) -> DataFrame:
    """The values at places of each group's ordered values: keys, ``n`` (values) and a column per name.

    ``ranks`` gives each place, from 0, as a function of ``n``. Nulls do not count, groups of nulls alone have no row; null keys are a group.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    values = df.where(F.col(col).isNotNull()).select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(col).alias("v"))
    about = values.groupBy(*names).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("n")).alias("rank")) for name, rank in ranks.items()]))
    places = _cut(about.select("*", wanted.alias("w")).select(*names, "n", "lo", "hi", "w.name", "w.rank", F.lit(0).cast("long").alias("below"), F.col("n").alias("within"), F.col("n").alias("kinds")))
    # equal values are counted, so what has to be ordered in one place are the different ones

    def inside(open_: DataFrame) -> DataFrame:
        """Values that lie in a place's range, with the place."""
        own = open_.select(*[F.col(n).alias(f"_p{n}") for n in names], *[c for c in open_.columns if c not in names])
        on = [F.col(n).eqNullSafe(F.col(f"_p{n}")) for n in names] + [F.col("v").between(F.col("lo"), F.col("hi"))]
        return values.join(own, reduce(lambda a, b: a & b, on))

    fine = (F.col("within") <= ordered) | (F.col("kinds") <= ordered / 2) | (F.col("lo") == F.col("hi"))
    done = None
    for _ in range(rounds):
        settled = places.where(fine)
        done = settled if done is None else done.unionByName(settled)
        open_ = places.where(~fine)
        if not open_.head(1):
            break
        cuts = F.percentile_approx("v", [i / _CUTS for i in range(_CUTS + 1)], 20 * _CUTS).alias("cuts")
        sketched = inside(open_).groupBy(*names, "name", "n", "rank", "below", "within", "lo", "hi").agg(cuts)
        at = F.floor((F.col("rank") - F.col("below")) / F.col("within") * _CUTS).cast("int")
        near = _cut(sketched.select("*", F.get("cuts", F.greatest(at - _MARGIN, F.lit(0))).alias("from"), F.get("cuts", F.least(at + 1 + _MARGIN, F.lit(_CUTS))).alias("to")).drop("cuts"))
        counted = inside(near).groupBy(*names, "name", "n", "rank", "below", "within", "lo", "hi", "from", "to").agg(
            F.count_if(F.col("v") < F.col("from")).alias("less"), F.count_if(F.col("v").between(F.col("from"), F.col("to"))).alias("here"),
            F.approx_count_distinct(F.when(F.col("v").between(F.col("from"), F.col("to")), F.col("v")), 0.02).alias("kinds"),
        )
        first = F.col("below") + F.col("less")
        held = (F.col("rank") >= first) & (F.col("rank") < first + F.col("here"))  # else the sketch was wrong, and the range stays
        narrow = lambda new, old: F.when(held, new).otherwise(F.col(old)).alias(old)
        places = _cut(counted.select(*names, "n", narrow(F.col("from"), "lo"), narrow(F.col("to"), "hi"), "name", "rank", narrow(first, "below"), narrow(F.col("here"), "within"), F.when(held, F.col("kinds")).otherwise(F.col("within")).alias("kinds")))
    else:
        raise NotNarrowed(f"a range of more than {ordered} values is left after {rounds} rounds")
    done = _cut(done)
    # a range of one value is that value, however often it stands there
    single = done.where(F.col("lo") == F.col("hi")).select(*names, "n", "name", F.col("lo").alias("v"))
    counts = inside(done.where(F.col("lo") != F.col("hi"))).groupBy(*names, "n", "name", "rank", "below", "v").agg(F.count("*").alias("c"))
    upto = F.col("below") + F.sum("c").over(Window.partitionBy(*names, "name").orderBy("v"))
    several = counts.withColumn("upto", upto).where(F.col("upto") > F.col("rank")).groupBy(*names, "n", "name").agg(F.min("v").alias("v"))
    out = single.unionByName(several).groupBy(*names, "n").agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in ranks])
    return out.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], "n", *ranks)

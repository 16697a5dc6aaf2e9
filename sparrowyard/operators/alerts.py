"""Alerts of payment rules under one id per rule, accounts and minute, so that a rule that goes on firing raises one a minute.

An alert's id is made from its content only: the same transactions give the same ids in a batch, on a stream and
after a restart, and a sink that ignores ids it knows (``relational.insert_ignore``) takes each alert once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowyard.operators import cycles, ledger
from sparrowyard.operators import relational as R

#: Columns of an alert; ``n`` counts the transactions that it is about.
ALERT = ["alert_id", "pattern", "accounts", "minute", "ms", "amount_cents", "n"]
MINUTE = 60_000


def minute_of(ms: Column) -> Column:
    return F.floor(ms / MINUTE)


def alert_id(pattern: Column, accounts: Column, ms: Column) -> Column:
    """The first 16 hex digits of the SHA-1 of ``pattern|accounts|minute``."""
    return F.substring(F.sha1(F.concat_ws("|", pattern, accounts, minute_of(ms).cast("string")).cast("binary")), 1, 16)


def identified(hits: DataFrame) -> DataFrame:
    """``hits(pattern, accounts, ms, ...)`` with their id and minute."""
    return hits.withColumn("alert_id", alert_id(F.col("pattern"), F.col("accounts"), F.col("ms"))).withColumn("minute", minute_of(F.col("ms")))


def first_of_minute(hits: DataFrame) -> DataFrame:
    """One alert per id: the earliest hit, ties to the smallest transactions (``tx_ids``, the one that fired first)."""
    first = F.min(F.struct("ms", "tx_ids", "pattern", "accounts", "minute", "amount_cents", "n")).alias("x")
    return identified(hits).groupBy("alert_id").agg(first).select("alert_id", *[F.col(f"x.{c}").alias(c) for c in ALERT[1:]])


def _bursts(pattern: str, found: DataFrame) -> DataFrame:
    return found.select(F.lit(pattern).alias("pattern"), F.col("orig").cast("string").alias("accounts"), "ms", F.col("total").alias("amount_cents"), "n", F.array("tx_id").alias("tx_ids"))


def cycle_hits(transfers: DataFrame, span: int = 600_000, min_total: int = 100_000_000) -> DataFrame:
    """Cycles of two and three transfers, at the time of the one that closes them; accounts from its origin on, three of them."""
    two = ledger.closed2(transfers, span, min_total).select(
        F.lit("CYCLE").alias("pattern"), F.concat_ws(",", "a", "b", "a").alias("accounts"), "ms", F.col("total").alias("amount_cents"), F.lit(2).cast("long").alias("n"), F.array("tx2", "tx1").alias("tx_ids"))
    three = ledger.closed3(transfers, span, min_total).select(
        F.lit("CYCLE").alias("pattern"), F.concat_ws(",", "a", "b", "c").alias("accounts"), "ms", F.col("total").alias("amount_cents"), F.lit(3).cast("long").alias("n"), F.array("tx3", "tx1", "tx2").alias("tx_ids"))
    return two.unionByName(three)


def hits(tx: DataFrame, velocity: tuple = (15, 60_000), structuring: tuple = (8, 3_600_000, 1_000_000), cycle: tuple = (600_000, 100_000_000), kinds: tuple = ("TRANSFER",)) -> DataFrame:
    """Every firing of every rule; ``kinds`` of transactions form cycles."""
    return R.union_all(
        _bursts("VELOCITY", ledger.velocity(tx, *velocity)), _bursts("STRUCTURING", ledger.structuring(tx, *structuring)), cycle_hits(tx.where(F.col("type").isin(*kinds)), *cycle),
    )


def _cycles(hits: DataFrame, hops: int) -> DataFrame:
    names = [f"a{i}" for i in range(hops)]
    ids = F.array(*[f"tx{i}" for i in range(hops)])
    return hits.select(
        F.lit("CYCLE").alias("pattern"), F.concat_ws(",", *names, *(names[:1] if hops == 2 else [])).alias("accounts"), "ms",
        F.col("total").alias("amount_cents"), F.lit(hops).cast("long").alias("n"), ids.alias("tx_ids"))


def cycle_alerts(transfers: DataFrame, span: int = 600_000, min_total: int = 100_000_000, cell: int = cycles.CELL) -> DataFrame:
    """``first_of_minute`` of ``cycle_hits``, without making the hits: cells look the first of a minute up (``cycles.first_of_cell``).

    A cell without parts has all transfers of its accounts and minutes, so its alerts are final; only those of others meet in a shuffle.
    """
    done, rest = [], []
    for hops in (2, 3):
        whole, parts = cycles.first_found(transfers, hops, span, min_total, MINUTE, cell)
        done.append(identified(_cycles(whole, hops)).select(*ALERT))
        rest.append(_cycles(parts, hops))
    return R.union_all(*done, first_of_minute(R.union_all(*rest)))


def alerts(tx: DataFrame, velocity: tuple = (15, 60_000), structuring: tuple = (8, 3_600_000, 1_000_000), cycle: tuple = (600_000, 100_000_000), kinds: tuple = ("TRANSFER",)) -> DataFrame:
    """Alerts of all rules, one per id: columns ``ALERT``. Rules as for ``hits``, whose ``first_of_minute`` they are."""
    bursts = R.union_all(_bursts("VELOCITY", ledger.velocity(tx, *velocity)), _bursts("STRUCTURING", ledger.structuring(tx, *structuring)))
    return first_of_minute(bursts).unionByName(cycle_alerts(tx.where(F.col("type").isin(*kinds)), *cycle))

"""Sharding by a hierarchical weighted hash tree of regions, racks and shards.

At every level a row draws one number for each child, ``-ln(u) / weight`` with ``u`` from an MD5 hash of
the row's key and the child's name, and descends into the smallest. A child's draw depends on nothing but
the key, its own name and its own weight, so a change of weights moves rows only into subtrees whose
weight grew, or out of those whose weight fell. ``grow`` hangs a new shard below a region of its own: no
other draw changes, so every row that moves goes into the new shard.

Only built-in SQL functions run here. Defined results: a null key is the key ``""``; a null text has no
bytes and CRC 0; repeated rows share a shard and get slots of their own; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: region -> rack -> shard -> weight
Tree = dict[str, dict[str, dict[int, float]]]


def tree_of(n_shards: int, per_rack: int = 2, racks_per_region: int = 2) -> Tree:
    """Full regions as far as ``n_shards`` fills them; each shard beyond hangs below a region of its own."""
    full = per_rack * racks_per_region
    tree: Tree = {}
    for shard in range(n_shards - n_shards % full):
        region, rack = f"region{shard // full}", f"rack{shard % full // per_rack}"
        tree.setdefault(region, {}).setdefault(rack, {})[shard] = 1.0
    for shard in range(n_shards - n_shards % full, n_shards):
        tree = grow(tree, shard)
    return tree


def grow(tree: Tree, shard: int, weight: float = 1.0) -> Tree:
    """The tree with one more shard below a region of its own."""
    return tree | {f"region-of-{shard}": {"rack0": {shard: weight}}}


def _weight(node) -> float:
    return sum(map(_weight, node.values())) if isinstance(node, dict) else node


def _pick(key: Column, children: dict, path: str) -> Column:
    """Name of the child with the smallest weighted draw."""
    def draw(name) -> Column:
        digest = F.substring(F.md5(F.concat(key, F.lit(f"|{path}{name}"))), 1, 12)
        u = (F.conv(digest, 16, 10).cast("double") + 0.5) / F.lit(float(2**48))
        return -F.log(u) / F.lit(float(_weight(children[name])))

    draws = [F.struct(draw(name).alias("d"), F.lit(str(name)).alias("name")) for name in children]
    return (F.least(*draws) if len(draws) > 1 else draws[0])["name"]


def assigned(df: DataFrame, key: str, tree: Tree, to: str) -> DataFrame:
    """``df`` with the shard of each row in int column ``to``: three draws a row, no shuffle."""
    k = F.coalesce(F.col(key).cast("string"), F.lit(""))
    region, rack = F.col("__region"), F.col("__rack")
    df = df.withColumn("__region", _pick(k, tree, ""))
    choice = F.lit(None).cast("string")
    for r, racks in tree.items():
        choice = F.when(region == r, _pick(k, racks, f"{r}/")).otherwise(choice)
    df = df.withColumn("__rack", choice)
    choice = F.lit(None).cast("string")
    for r, racks in tree.items():
        for a, shards in racks.items():
            choice = F.when((region == r) & (rack == a), _pick(k, shards, f"{r}/{a}/")).otherwise(choice)
    return df.withColumn(to, choice.cast("int")).drop("__region", "__rack")


def slotted(df: DataFrame, shard: str, order: list[str], bins: int = 256) -> DataFrame:
    """Number the rows of each shard gaplessly from 0 in long column ``slot``.

    A shard may hold a large part of all rows, so it is numbered in ``bins`` hash bins: each bin by itself,
    plus the rows of the bins before it. The table of bin counts has shards x ``bins`` rows at most.
    """
    df = df.withColumn("__bin", F.pmod(F.xxhash64(*order), F.lit(bins)).cast("int"))
    counts = df.groupBy(shard, "__bin").agg(F.count("*").alias("__n"))
    before = counts.withColumn(
        "__before",
        F.coalesce(F.sum("__n").over(Window.partitionBy(shard).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    ).drop("__n")
    at = F.row_number().over(Window.partitionBy(shard, "__bin").orderBy(*order)) - 1
    return df.withColumn("__at", at).join(F.broadcast(before), [shard, "__bin"]).withColumn("slot", (F.col("__at") + F.col("__before")).cast("long")).drop("__at", "__before", "__bin")


def shard_documents(docs: DataFrame, n_shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard, slot and the shard after growth by one, for every document; law ``key``."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(t) + 1).cast("long").alias("size"),
        F.crc32(t.cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    tree = tree_of(n_shards)
    rows = assigned(rows, "doc_id", tree, "shard")
    rows = assigned(rows, "doc_id", grow(tree, n_shards), "grown_shard")
    return slotted(rows, "shard", ["doc_id", "size", "text_crc32"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")

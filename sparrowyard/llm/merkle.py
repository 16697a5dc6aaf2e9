"""A Merkle manifest of a dataset: hash trees per language below one root, and proofs climbed by a recursive query.

Every row is a leaf. The leaves of a group ascend by id and pair up level by level until one node, the group's
subroot, is left; the subroots pair up likewise to the root. The tree is stored as **parent-linked node rows**: a
row holds a node's digest, the link to its ancestor ``SPAN`` levels up (or to the subroot's place in the tree
above), the siblings passed on the way there and the ancestor's digest. A **recursive query** starts at each
leaf, joins the row that its link names, appends that row's siblings and folds the (perhaps tampered) hash over
them, until the root's row, which has no parent.

Work and rows: a leaf takes part in one shuffle to build the lowest ``SPAN`` levels (every next stored level is 512
times smaller) and in one join for each ``SPAN`` levels of the climb. Positions come from range partitions, so no
group is one task. The rows above the leaves' own are counted: up to ``BROADCAST`` they are sent to all tasks, beyond
it they are joined by key, those that many leaves meet once per salt.

Defined results: null fields are hashed as ``-``; null ids come first within their group; rows of one id are
ordered by their leaves, and rows alike in every field are leaves of their own; a null group is a group,
ordered first; a group of one row has its leaf as subroot; an empty table gives no rows.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparrowyard.llm.common import written

#: Levels between a node row and the ancestor that it links to.
SPAN = 9
#: Rows above the leaves' own that are broadcast at most; a row holds some 500 bytes.
BROADCAST = 100_000
#: Copies of rows from the second link on, so that leaves which climb to one node meet in several tasks.
SALTS = 64
#: Number of the tree above all groups.
ABOVE = -1


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the count of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*fields: Column) -> Column:
    return sha(F.concat(*map(field, fields)))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``tree`` (rank of the group), ``pos`` (place within it), ``n`` (its size); ``group`` is not null.

    Rows are range-partitioned by group and order. What is ranked in one place has a row per partition; counts
    per partition and group are ranked by group.
    """
    dealt = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    dealt = written(dealt.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ordered")
    by_group = Window.partitionBy(group).orderBy("part")
    cells = dealt.groupBy("part", group).agg(F.count("*").alias("here"), F.min("at").alias("first"))
    cells = written(cells.select(
        "part", group, "first", F.coalesce(F.sum("here").over(by_group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("here").over(Window.partitionBy(group)).alias("n"),
    ), "cells")
    begun = cells.where("before = 0").withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy(group)))
    parts = begun.groupBy("part").agg(F.count("*").alias("c"))
    offsets = parts.select("part", (F.sum("c").over(Window.orderBy("part")) - F.col("c")).alias("o"))  # a row per partition
    trees = begun.join(offsets, "part").select(group, (F.col("o") + F.col("k") - 1).alias("tree"))
    cells = written(cells.join(trees, group).select("part", group, "first", "before", "n", "tree"), "cells")
    return dealt.join(cells, ["part", group]).select(*rows.columns, "tree", (F.col("before") + F.col("at") - F.col("first")).alias("pos"), "n")


def _hex(digest: Column) -> Column:
    return F.coalesce(F.lower(F.hex(digest)), F.lit(""))


def _above(level: Column) -> Column:
    """The level of nodes above an array of nodes: every two consecutive ones hashed, an odd last one alone."""
    pair = lambda i: F.unhex(F.sha2(F.concat(_hex(F.get(level, 2 * i)), _hex(F.get(level, 2 * i + 1))).cast("binary"), 256))
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int")), pair)


def height(n: Column) -> Column:
    """Levels above the leaves of a tree of ``n`` leaves."""
    return F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1))).cast("int")


def node_rows(nodes: DataFrame, level: int, above: bool) -> DataFrame:
    """Parent-linked rows of one stored level: ``nodes`` has ``tree, pos, n, digest`` and ``more``, kept as it is.

    ``siblings`` are those passed on the way to the linked ancestor, lowest first, with their side; ``up`` is the
    ancestor's digest. A tree's last link leads to its place in the tree above; there it is null.
    """
    left = (height(F.col("n")) - SPAN * level).alias("left")
    blocks = nodes.groupBy("tree", F.shiftright("pos", SPAN).alias("block"), "n").agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "more"))).alias("run"))
    blocks = blocks.select("*", left, F.col("run.digest").alias("d0"))
    for k in range(SPAN):
        blocks = blocks.withColumn(f"d{k + 1}", F.when(F.col("left") > k, _above(F.col(f"d{k}"))).otherwise(F.col(f"d{k}")))
    at = lambda i, k: F.shiftright(i, k)
    step = lambda i, k: F.struct((at(i, k) % 2 == 1).alias("before"), F.get(F.col(f"d{k}"), at(i, k).bitwiseXOR(F.lit(1))).alias("digest"))
    steps = lambda i: F.slice(F.array(*[step(i, k) for k in range(SPAN)]), F.lit(1), F.greatest(F.lit(0), F.least(F.lit(SPAN), F.col("left"))))
    passed = F.transform("run", lambda r, i: F.struct(r["pos"].alias("pos"), r["digest"].alias("digest"), r["more"].alias("more"), steps(i).alias("siblings")))
    rows = blocks.select("tree", "block", "n", "left", F.get(f"d{SPAN}", F.lit(0)).alias("up"), F.explode(passed).alias("r"))
    last = F.col("left") <= SPAN
    return rows.select(
        "tree", F.lit(level).alias("level"), F.col("r.pos").alias("pos"), "n", F.col("r.digest").alias("digest"), F.col("r.more").alias("more"), F.col("r.siblings").alias("siblings"), "up",
        F.when(~last, F.col("tree")).otherwise(F.lit(None if above else ABOVE)).cast("long").alias("to_tree"),
        F.when(last, 0).otherwise(level + 1).alias("to_level"),
        F.when(~last, F.col("block")).otherwise(F.col("tree")).cast("long").alias("to_pos"),
    )


def _grown(leaves: DataFrame, above: bool) -> list[DataFrame]:
    """Stored levels of node rows above ``leaves`` (``tree, pos, n, digest, more``), lowest first.

    The driver sees the largest tree's height.
    """
    levels = [written(node_rows(leaves, 0, above), "nodes")]
    top = levels[0].agg(F.max(height(F.col("n")))).first()[0] or 0
    for level in range(1, -(-top // SPAN)):
        below = levels[-1].where(F.col("to_level") == level).where(F.col("pos") % (1 << SPAN) == 0)
        nodes = below.select("tree", F.col("to_pos").alias("pos"), "n", F.col("up").alias("digest"), F.lit(None).cast("string").alias("more"))
        levels.append(written(node_rows(nodes, level, above), "nodes"))
    return levels


@contextmanager
def _any_rows(spark: SparkSession):
    """Recursive queries may give any number of rows, for the time of one write."""
    name = "spark.sql.cteRecursionRowLimit"
    old = spark.conf.get(name, None)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        spark.conf.unset(name) if old is None else spark.conf.set(name, old)


def _folded(hash: str, siblings: str) -> str:
    """SQL: the hash folded over siblings, each on its own side."""
    return f"aggregate({siblings}, {hash}, (h, s) -> unhex(sha2(CAST(concat(if(s.before, lower(hex(s.digest)), ''), lower(hex(h)), if(NOT s.before AND s.digest IS NOT NULL, lower(hex(s.digest)), '')) AS BINARY), 256)))"


def _passed(siblings: str) -> str:
    """SQL: the digests among siblings, one after another; an odd last node has none."""
    return f"aggregate({siblings}, CAST('' AS BINARY), (p, s) -> if(s.digest IS NULL, p, concat(p, s.digest)))"


CLIMB = f"""
WITH RECURSIVE climb AS (
    SELECT doc_id, leaf, salt, CAST(CASE WHEN to_tree = {ABOVE} THEN up END AS BINARY) AS subroot, CAST(NULL AS BINARY) AS root,
        {_folded("given", "siblings")} AS folded, {_passed("siblings")} AS proof, to_tree, to_level, to_pos
    FROM {{leaves}}
    UNION ALL
    SELECT {{how}} c.doc_id, c.leaf, c.salt, coalesce(c.subroot, CASE WHEN n.to_tree = {ABOVE} THEN n.up END) AS subroot, CASE WHEN n.to_tree IS NULL THEN n.up END AS root,
        {_folded("c.folded", "n.siblings")} AS folded, concat(c.proof, {_passed("n.siblings")}) AS proof, n.to_tree, n.to_level, n.to_pos
    FROM climb c JOIN {{nodes}} n ON c.to_tree = n.tree AND c.to_level = n.level AND c.to_pos = n.pos {{salted}}
)
SELECT doc_id, leaf, subroot, root, folded, proof FROM climb WHERE to_tree IS NULL
"""


def manifest(leaves: DataFrame, group: str = "lang", id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The stored tree of ``leaves``: node rows of the leaves themselves and of all levels above.

    ``leaves`` has ``id``, ``group``, ``leaf`` (hex) and ``given``, the leaf as it is now. Rows of the first table
    have them in ``more``.
    """
    keyed = leaves.select(
        F.when(F.col(group).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(group).cast("string"))).alias("g"), F.col(id).alias("doc_id"),
        F.unhex("leaf").alias("digest"), F.unhex("given").alias("given"),
    )
    placed = numbered(keyed, "g", ["doc_id", "digest", "given"])
    low, *high = _grown(placed.select("tree", "pos", "n", "digest", F.struct("doc_id", "given").alias("more")), above=False)
    tops = low
    for x in high:
        tops = tops.drop("more").unionByName(x.drop("more"))
    subroots = written(tops.where((F.col("to_tree") == ABOVE) & (F.col("pos") == 0)).select("tree", F.col("up").alias("digest")), "subroots")
    n = subroots.count()
    upper = _grown(subroots.select(F.lit(ABOVE).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(n).cast("long").alias("n"), "digest", F.lit(None).cast("string").alias("more")), above=True)
    nodes = None
    for x in [*high, *upper]:
        x = x.drop("more")
        nodes = x if nodes is None else nodes.unionByName(x)
    return low, nodes


def proofs(leaves: DataFrame, group: str = "lang", id: str = "doc_id") -> DataFrame:
    """Each leaf's way to the root: ``doc_id, leaf, subroot, root, folded`` (from the given leaf) and ``proof`` (siblings in order).

    Digests are binary, those of ``proof`` one after another; ``leaves`` as for ``manifest``.
    """
    spark = leaves.sparkSession
    low, nodes = manifest(leaves, group, id)
    small = nodes.count() <= BROADCAST
    salts = F.when((F.col("tree") != ABOVE) & (F.col("level") == 1), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    start = low.select(F.col("more.doc_id").alias("doc_id"), F.col("digest").alias("leaf"), F.col("more.given").alias("given"), (F.col("pos") % SALTS).cast("int").alias("salt"), "siblings", "up", "to_tree", "to_level", "to_pos")
    stored = nodes if small else written(nodes.withColumn("salt", F.explode(salts)), "node-rows")
    climb = CLIMB.replace("{how}", "/*+ BROADCAST(n) */" if small else "").replace("{salted}", "" if small else "AND if(c.to_level = 1, 0, c.salt) = n.salt")
    with _any_rows(spark):
        return written(spark.sql(climb, leaves=start, nodes=stored), "proofs")


def verified(docs: DataFrame, tampered: Column, fields: list[str], changed: dict[str, Column], group: str = "lang", id: str = "doc_id") -> DataFrame:
    """Leaves of ``docs`` from ``fields``, and what their proofs say once rows where ``tampered`` holds have ``changed`` values.

    ``doc_id, leaf, subroot, root, proof_sha256, folded_root`` (hex) and ``verified``.
    """
    now = leaf_of(*[changed.get(f, F.col(f)) for f in fields])
    leaf = leaf_of(*[F.col(f) for f in fields])
    leaves = written(docs.select(F.col(id).alias("doc_id"), F.col(group).alias("lang"), leaf.alias("leaf"), F.when(tampered, now).otherwise(leaf).alias("given")), "leaves")
    found = proofs(leaves)
    return found.select(
        "doc_id", _hex(F.col("leaf")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), _hex(F.col("root")).alias("root"),
        sha(_hex(F.col("proof"))).alias("proof_sha256"), _hex(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )

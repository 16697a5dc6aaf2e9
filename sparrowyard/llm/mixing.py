"""Mixing sources to target weights by entropy balancing.

Among all rates ``0 <= r <= cap`` per document that meet the word targets of every source, take the ones
closest to the documents' base rates in relative entropy over words, while classes of documents by length keep
the share of words that they have in the corpus. The sources' targets are hard constraints. The classes' are soft
ones, by a quadratic penalty, as both need not be possible at once. The convex dual has one variable lambda per
source and one variable mu per class, and its solution tilts the base rates exponentially:
``r = min(cap, base * exp(lambda + mu))``.

Newton iterations solve the dual. Each is one aggregation over all documents into words and slopes per source and
class. The Hessian is diagonal over sources and couples every source with every class, so the sources are
eliminated in SQL (a Schur complement), which leaves a system of 8 unknowns for the driver; the sources' steps
follow from its solution, again in SQL. The driver sees one row of sums a round, whatever the number of sources.

Rates become whole copies by systematic rounding along a sweep from long to short documents, cut into bins
so that no source is one task; a source's rounding error is then about its longest document, and a few
exchange steps add or drop one copy of the document that fits the rest best.

Only built-in SQL functions run here, and per-source tables are broadcast only where Spark finds them
small. Defined results: a null text has size 0; documents of size 0 are taken 0 times as words go; a null
source is a source of its own, ordered last; repeated rows are rows of their own; an empty table stays empty;
a dual that does not settle raises ``NotSolved``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowyard.llm.common import n_words_of, written


#: Classes by length: class k > 0 begins at 32 * 2 ** (k - 1) words, the last one has no end.
CLASSES = 8


#: Lambda of sources that take all that the cap allows.
CAPPED = 60


class NotSolved(RuntimeError):
    """Newton's iterations reached their limit before the constraints were met."""


def length_class(size: Column) -> Column:
    """0 below 32 words, one more for each doubling, at most ``CLASSES - 1``."""
    return F.greatest(F.lit(0), F.least(F.lit(CLASSES - 1), F.floor(F.log2(F.greatest(size, F.lit(1)) / 32)) + 1)).cast("int")


def source_key(source: Column) -> Column:
    """A key that is never null and sorts by code point, null last."""
    return F.when(source.isNull(), "2").otherwise(F.concat(F.lit("1"), source.cast("string")))


def targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, share: float = 1.0) -> DataFrame:
    """Target words per source: columns ``src``, ``source_size``, ``target``.

    ``sources`` has a row per source (``src``, ``source_size``). Sources in order take the weights in turn
    and share ``share`` of all words; a target stops at ``cap`` times the source's size, and the excess is
    shared again by weight among the rest until none is above. In closed form: by size / weight, a source
    is capped while the level that the rest would get exceeds its own cap. One row per source meets in the
    windows, never documents.
    """
    every = Window.partitionBy(F.lit(0))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("k") % len(weights)) + 1)
    ranked = sources.withColumn("k", (F.row_number().over(every.orderBy(F.col("src").cast("binary"))) - 1).cast("int")).withColumn("w", w)
    sweep = every.orderBy(F.col("source_size") / F.col("w"), "k")
    before = sweep.rowsBetween(Window.unboundedPreceding, -1)
    level = ranked.select(
        "src", "source_size", "w",
        F.row_number().over(sweep).alias("rank"),
        ((F.sum("source_size").over(every) * share - F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0.0)))
         / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))).alias("water"),
    )
    first = F.min(F.when(F.col("water") * F.col("w") <= F.col("source_size") * cap, F.struct("rank", "water"))).over(every)
    capped = F.col("rank") < F.coalesce(first["rank"], F.col("rank") + 1)
    return level.select("src", "source_size", F.when(capped, F.col("source_size") * cap).otherwise(first["water"] * F.col("w")).alias("target"))


def _solved(a: list[list[float]], b: list[float]) -> list[float]:
    """Solution of a small positive definite system, by elimination."""
    n, m = len(b), [[*row, y] for row, y in zip(a, b, strict=True)]
    for k in range(n):
        for i in range(k + 1, n):
            f = m[i][k] / m[k][k]
            m[i] = [x - f * y for x, y in zip(m[i], m[k], strict=True)]
    out = [0.0] * n
    for k in reversed(range(n)):
        out[k] = (m[k][n] - sum(m[k][j] * out[j] for j in range(k + 1, n))) / m[k][k]
    return out


def rate_of(lam: Column, cls: Column, mu: list[float], base: Column) -> Column:
    """The tilted rate before its cap."""
    return base * F.exp(lam + F.element_at(F.array(*[F.lit(float(x)) for x in mu]), cls + 1))


def balance(rows: DataFrame, goals: DataFrame, cap: float = 3.0, softness: float = 0.1, rounds: int = 60, near: float = 1e-9) -> tuple[DataFrame, list[float]]:
    """Dual variables: ``goals`` with column ``lam``, and the list mu of the classes.

    ``rows`` has ``src``, ``size``, ``cls`` and ``base`` (a positive base rate); ``softness`` is the penalty's
    width in shares of all words (towards infinity the classes do not count). Steps are held to 2 in each variable;
    where caps make them leap to and fro, and the error does not halve in two rounds, they get shorter.
    """
    ks = range(CLASSES)
    known = rows.groupBy("cls").agg(F.sum("size").alias("n"))
    share = {r.cls: float(r.n) for r in known.collect()}  # a row per class
    words, mu = sum(share.values()), [0.0] * CLASSES
    start = F.when((F.col("target") > 0) & (F.col("source_size") > 0), F.log(F.col("target") / F.col("source_size"))).otherwise(0.0)
    # a source whose target is all that the cap allows takes every document ``cap`` times; its rates are known and no unknowns
    full = (F.col("target") > 0) & (F.col("target") >= F.col("source_size") * cap * (1 - 1e-12))
    state = written(goals.withColumn("lam", F.when(full, float(CAPPED)).otherwise(F.least(start, F.lit(float(cap))))), "dual")
    if not words:
        return state, mu
    total = float(goals.agg(F.sum("target")).first()[0] or 0.0)
    wanted = [share.get(k, 0.0) / words * total / words for k in ks]
    best, stale, pace = float("inf"), 0, 1.0
    for _ in range(rounds):
        rate = rate_of(F.col("lam"), F.col("cls"), mu, F.col("base"))
        cells = rows.join(state.select("src", "lam"), "src").groupBy("src", "cls").agg(
            (F.sum(F.col("size") * F.least(rate, F.lit(float(cap)))) / words).alias("have"),
            (F.sum(F.when(rate < cap, F.col("size") * rate).otherwise(0.0)) / words).alias("slope"),
        )
        of = lambda c, k: F.coalesce(F.sum(F.when(F.col("cls") == k, F.col(c))), F.lit(0.0)).alias(f"{c}{k}")
        by_source = cells.groupBy("src").agg(*[of(c, k) for c in ("have", "slope") for k in ks])
        both = written(state.join(by_source, "src", "left").select(*state.columns, *[F.coalesce(f"{c}{k}", F.lit(0.0)).alias(f"{c}{k}") for c in ("have", "slope") for k in ks]), "newton")
        have, slope = sum(F.col(f"have{k}") for k in ks), sum(F.col(f"slope{k}") for k in ks)
        known = (F.col("lam") >= CAPPED) | (F.col("target") <= 0)
        gap = F.col("target") / words - have
        open_ = (slope > 1e-15) & ~known
        inverse = F.when(open_, 1 / slope).otherwise(0.0)
        # what a source cannot reach at all rates capped or all sizes 0 is no miss
        miss = F.when(~known & (open_ | (gap < 0)), F.abs(gap) * words / F.col("target")).otherwise(0.0)
        # the step for the logarithm of the words: they are concave in lambda, so a source comes to its target from below
        # and does not leap to where all its rates are capped
        wants = F.when(open_, have * F.log(F.col("target") / words / have)).otherwise(0.0)
        pairs = [(a, b) for a in ks for b in ks if a <= b]
        one = both.agg(
            F.max(miss).alias("miss"),
            *[F.sum(F.col(f"have{k}")).alias(f"h{k}") for k in ks], *[F.sum(F.col(f"slope{k}")).alias(f"s{k}") for k in ks], *[F.sum(F.col(f"slope{k}") * inverse * wants).alias(f"v{k}") for k in ks],
            *[F.sum(F.col(f"slope{a}") * F.col(f"slope{b}") * inverse).alias(f"m{a}_{b}") for a, b in pairs],
        ).first()
        off = [wanted[k] - one[f"h{k}"] - softness * mu[k] for k in ks]
        if (one.miss or 0.0) <= near and max(map(abs, off)) <= near:
            return state, mu
        error = max(one.miss or 0.0, *map(abs, off))
        if error <= best / 2:
            best, stale, pace = error, 0, 1.0
        else:
            stale += 1
            pace = pace if stale < 2 else max(0.1, 0.7 * pace)
        schur = [[(one[f"s{a}"] + softness if a == b else 0.0) - one[f"m{min(a, b)}_{max(a, b)}"] for b in ks] for a in ks]
        step = [max(-2.0, min(2.0, x)) for x in _solved(schur, [off[k] - one[f"v{k}"] for k in ks])]
        push = wants - sum(F.col(f"slope{k}") * step[k] for k in ks)
        # a source whose rates are all capped has no slope; it comes down by whole steps
        over = -gap * words > near * F.col("target")
        move = F.when(open_, F.greatest(F.lit(-2.0), F.least(F.lit(2.0), push * inverse))).when(~known & over, -0.5).otherwise(0.0)
        state = written(both.select(*goals.columns, (F.col("lam") + pace * move).alias("lam")), "dual")
        mu = [m + pace * x for m, x in zip(mu, step, strict=True)]
    raise NotSolved(f"constraints are missed by {one.miss} after {rounds} rounds")


#: Rates are rounded to 2 ** -20 before they become copies.
UNIT_BITS = 20


def rounded(rows: DataFrame, goals: DataFrame, mu: list[float], cap: int = 3, bins: int = 64, exchanges: int = 4) -> DataFrame:
    """Whole copies per document from rates: ``id, src, size, source_size, target, rate, copies, taken``.

    ``rows`` has ``id``, ``src``, ``size``, ``cls``, ``base``; ``goals`` has ``src``, ``source_size``, ``target``, ``lam``.
    """
    rate = F.when(F.col("target") > 0, F.least(rate_of(F.col("lam"), F.col("cls"), mu, F.col("base")), F.lit(float(cap)))).otherwise(0.0)
    # whole units, so that running sums are exact: neither the order of rows nor their number changes the result
    rate = F.round(rate * (1 << UNIT_BITS)).cast("long")
    rated = rows.join(goals, "src").select(
        "id", "src", "size", "source_size", "target", rate.alias("rate"),
        (-F.floor(F.log2(F.col("size") + 1) * 8)).cast("int").alias("sweep"),
        F.pmod(F.xxhash64("id", "size"), F.lit(bins)).cast("int").alias("bin"),
    )
    cell = ["src", "sweep", "bin"]
    # ties beyond id and size are alike, so their order does not change the result
    within = Window.partitionBy(*cell).orderBy("id", "size", "rate").rowsBetween(Window.unboundedPreceding, 0)
    along = Window.partitionBy("src").orderBy("sweep", "bin").rowsBetween(Window.unboundedPreceding, -1)
    cells = rated.groupBy(*cell).agg(F.sum("rate").alias("cell"))
    before = cells.select(*cell, F.coalesce(F.sum("cell").over(along), F.lit(0).cast("long")).alias("before"))
    edge = F.col("before") + F.col("upto") + (1 << UNIT_BITS - 1)
    copies = (F.shiftright(edge, UNIT_BITS) - F.shiftright(edge - F.col("rate"), UNIT_BITS)).cast("int")
    result = written(
        rated.withColumn("upto", F.sum("rate").over(within)).join(before, cell).select("id", "src", "size", "source_size", "target", (F.col("rate") / (1 << UNIT_BITS)).alias("rate"), copies.alias("copies")),
        "copies",
    )
    rest = written(result.groupBy("src").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("rest")), "rest")
    alike, moves = ["src", "id", "size", "copies"], None
    for _ in range(exchanges):
        gap = F.abs(F.abs("rest") - F.col("size"))
        can = F.when(F.col("rest") > 0, F.col("copies") < cap).otherwise(F.col("copies") > 0) & (F.col("size") > 0) & (gap < F.abs("rest"))
        offered = result.join(rest, "src").where(can)
        if moves is not None:
            gone = moves.select(F.col("src").alias("s"), F.col("id").alias("i"), F.col("size").alias("z"))
            offered = offered.join(gone, (F.col("src") == F.col("s")) & F.col("id").eqNullSafe(F.col("i")) & (F.col("size") == F.col("z")), "left_anti")
        move = F.signum("rest").cast("int")
        best = offered.groupBy("src").agg(F.min_by(F.struct("id", "size", "copies", move.alias("move")), F.struct(gap.alias("gap"), "id", "copies")).alias("b")).select("src", "b.*")
        best = written(best, "moves")
        moves = best if moves is None else moves.unionByName(best)
        rest = written(rest.join(best, "src", "left").select("src", (F.col("rest") - F.coalesce(F.col("move") * F.col("size"), F.lit(0))).alias("rest")), "rest")
    if moves is not None:
        named = moves.select(*[F.col(c).alias(f"m_{c}") for c in [*alike, "move"]])
        hit = (F.col("src") == F.col("m_src")) & F.col("id").eqNullSafe(F.col("m_id")) & (F.col("size") == F.col("m_size")) & (F.col("copies") == F.col("m_copies"))
        marked = result.join(named, hit, "left")
        alone = F.row_number().over(Window.partitionBy(*alike).orderBy("m_move")) == 1  # of rows alike, one moves
        moved = marked.where(F.col("m_move").isNotNull()).withColumn("copies", F.col("copies") + F.when(alone, F.col("m_move")).otherwise(0))
        result = marked.where(F.col("m_move").isNull()).select(*result.columns).unionByName(moved.select(*result.columns))
    return result.withColumn("taken", F.col("copies") * F.col("size"))


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), cap: int = 3, share: float = 1.0, softness: float = 0.1) -> DataFrame:
    """Rate, copies and words taken per document: ``doc_id, src, size, source_size, target, rate, copies, taken``."""
    sized = docs.select(F.col(id).alias("id"), source_key(F.col(source)).alias("src"), n_words_of(F.col(text)).alias("size"), F.lit(1.0).alias("base"))
    rows = written(sized.withColumn("cls", length_class(F.col("size"))), "sizes")
    goals = targets(rows.groupBy("src").agg(F.sum("size").alias("source_size")), weights, float(cap), share)
    solved, mu = balance(rows, goals, float(cap), softness)
    return rounded(rows, solved, mu, cap).withColumnRenamed("id", "doc_id")


def mixed_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", cap: int = 3, **how) -> DataFrame:
    """The documents themselves, each as often as the mix takes it; columns as given.

    Rows are joined to their copies by id, source and size. Rows alike in all three take the group's copies in
    order of their texts' hashes: their copies are counted, not paired, so the work is linear in them; such
    a group is numbered in one task. Texts are shuffled once.
    """
    copies = mix(docs, id, text, source, cap=cap, **how)
    key = ["i", "s", "z"]
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    left = docs.select(F.struct("*").alias("row"), name(F.col(id)).alias("i"), source_key(F.col(source)).alias("s"), n_words_of(F.col(text)).alias("z"), F.xxhash64(text).alias("h"))
    left = left.withColumn("o", F.row_number().over(Window.partitionBy(*key).orderBy("h"))).drop("h")
    # how many rows of the group have more than 0, 1, ... copies: the first ones take the most
    counts = copies.groupBy(name(F.col("doc_id")).alias("i"), F.col("src").alias("s"), F.col("size").alias("z")).agg(*[F.count_if(F.col("copies") > k).alias(f"n{k}") for k in range(cap)])
    joined = left.join(counts, key).withColumn("copies", sum((F.col("o") <= F.col(f"n{k}")).cast("int") for k in range(cap)))
    return joined.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")

"""Mixing sources to target weights: hierarchical budgeting over a domain, language, source tree.

Weights are propagated down the tree. A node's budget is shared among its children in proportion to their weights, each
child taking at most what its subtree can give (tokens times epochs); what a child lacks goes to its siblings first, and
to the ancestors' siblings only when the whole subtree is used up, because a subtree then asks for no more. All shares
are exact integers. Each leaf selects whole seeded epochs of its documents and the shortest prefix of the next epoch
that reaches the rest of its budget.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import stored, text_key

LEVELS = ("domain", "lang", "source")
BIG = "decimal(38,0)"


def leaf_budgets(leaves: DataFrame, budget: int, epochs: int, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """Leaves (levels..., tokens, <level>_weight...) with ``budget``: tokens the leaf gives.

    Weights are positive integers; zero and null give a node nothing. Water filling per parent: children in the order of capacity per weight
    are saturated while they take less than their share of what is left; the others share the rest, rounded down.
    """
    tree = leaves.withColumn("capacity", F.col("tokens").cast(BIG) * epochs)
    for k, level in enumerate(levels):  # a subtree without weight gives nothing, at any level
        tree = tree.withColumn("capacity", F.when(F.col(f"{level}_weight") > 0, F.col("capacity")).otherwise(F.lit(0)).cast(BIG))
    given = None
    for k, level in enumerate(levels):
        path = list(levels[: k + 1])
        nodes = tree.groupBy(*path).agg(F.sum("capacity").cast(BIG).alias("c"), F.max(F.coalesce(f"{level}_weight", F.lit(0))).cast(BIG).alias("w"))
        nodes = nodes.withColumn("c", F.when(F.col("w") > 0, F.col("c")).otherwise(F.lit(0).cast(BIG)))
        if given is None:
            nodes = nodes.withColumn("t", F.lit(budget).cast(BIG))
        else:
            up = given.select(*[F.col(p).alias(f"_{p}") for p in path[:-1]], F.col("budget").alias("t"))
            same = None
            for p in path[:-1]:
                one = F.col(p).eqNullSafe(F.col(f"_{p}"))
                same = one if same is None else same & one
            nodes = nodes.join(up, same).drop(*[f"_{p}" for p in path[:-1]])
        # ratios of integers below 2^53 order alike in double up to ties, whose order does not change the shares
        parent = Window.partitionBy(*path[:-1]) if k else Window.partitionBy(F.lit(0))
        order = parent.orderBy(F.when(F.col("w") > 0, F.col("c").cast("double") / F.col("w").cast("double")).asc_nulls_first(), *path)
        sums = order.rowsBetween(Window.unboundedPreceding, -1)
        nodes = nodes.withColumn("c0", F.coalesce(F.sum("c").over(sums), F.lit(0)).cast(BIG)).withColumn("w1", (F.sum("w").over(parent) - F.coalesce(F.sum("w").over(sums), F.lit(0))).cast(BIG))
        nodes = nodes.withColumn("t", F.least("t", F.sum("c").over(parent).cast(BIG)))
        nodes = nodes.withColumn("over", (F.col("w") > 0) & (F.col("c") * F.col("w1") > (F.col("t") - F.col("c0")) * F.col("w")))
        # the first child beyond its share fixes the rate of all that are not saturated
        rate = F.first(F.when(F.col("over"), F.struct((F.col("t") - F.col("c0")).cast(BIG).alias("left"), F.col("w1").alias("weights"))), ignorenulls=True)
        nodes = nodes.withColumn("rate", rate.over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        share = F.when(F.col("rate").isNull(), F.col("c")).otherwise(F.expr("(rate.left * w) div rate.weights").cast(BIG))
        given = nodes.select(*path, F.least(share.cast(BIG), F.col("c")).alias("budget"))
    return given.select(*levels, F.col("budget").cast("long").alias("budget"))


def select_prefixes(rows: DataFrame, budgets: DataFrame, seed: str, levels: tuple[str, ...] = LEVELS, buckets: int = 1024) -> DataFrame:
    """``rows`` (doc_id, _t1, _t2, levels..., tokens) once per epoch that takes them, with ``epoch`` (from 0).

    An epoch's order is md5(seed, epoch, doc_id), ties by doc_id and text key. A document is taken whole if the tokens
    before it in the epoch are below what the epoch has to give. The order of a leaf is cut by the leading digits of the
    digest: sums per cut decide every cut but the one that the prefix ends in, and only that one is ordered, so no leaf
    is ever in one task.
    """
    held = budgets.select(*[F.col(level).alias(f"_{level}") for level in levels], F.col("budget").alias("_budget"), F.col("tokens").alias("_all"))
    same = reduce(Column.__and__, [F.col(level).eqNullSafe(F.col(f"_{level}")) for level in levels])
    rows = rows.join(held.where("_budget > 0 and _all > 0"), same)
    rows = rows.withColumn("epoch", F.explode(F.expr("sequence(0, cast((_budget + _all - 1) div _all as int) - 1)")))
    rows = rows.withColumn("_give", F.col("_budget") - F.col("epoch") * F.col("_all"))
    place = F.md5(F.concat_ws("|", F.lit(seed), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = rows.withColumn("_place", place).withColumn("_cut", F.expr(f"cast(conv(substring(_place, 1, 8), 16, 10) as bigint) * {buckets} div {1 << 32}"))
    out = ["doc_id", "_t1", "_t2", *levels, "tokens", "epoch"]
    whole = rows.where("_give >= _all").select(*out)
    part = rows.where("_give < _all").withColumn("_leaf", F.xxhash64(*[F.coalesce(F.col(level).cast("string"), F.lit("\x00")) for level in levels]))
    part = stored(part.select(*out, "_leaf", "_place", "_cut", "_give"), "mixing-part")
    sums = part.groupBy("_leaf", "_cut").agg(F.sum("tokens").alias("_n"))
    before = Window.partitionBy("_leaf").orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    sums = stored(sums.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))), "mixing-cuts")
    part = part.join(sums, ["_leaf", "_cut"])
    order = Window.partitionBy("_leaf", "_cut").orderBy("_place", "doc_id", "_t1", "_t2").rowsBetween(Window.unboundedPreceding, -1)
    edge = part.where("_before < _give and _before + _n >= _give").withColumn("_run", F.coalesce(F.sum("tokens").over(order), F.lit(0)) + F.col("_before"))
    return whole.union(part.where("_before + _n < _give").select(*out)).union(edge.where("_run < _give").select(*out))


def mix(docs: DataFrame, weights: dict[str, dict[str, int]], share: float = 1.0, epochs: int = 2, seed: str = "mix", doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", domains: int = 4) -> DataFrame:
    """Documents to take: doc_id, ``_t1``, ``_t2``, domain, lang, source, ``tokens`` (words), ``epoch``.

    ``share`` of all tokens is the budget; ``weights`` are positive integers by level and value, 1 where none is given.
    A source's domain is ``domain<k>``, k its trailing number modulo ``domains``; sources without one are in ``other``.
    Null languages and sources are nodes like any other. Texts without words take nothing from a budget; a leaf
    without any gives nothing. Repeated rows are documents of their own.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), *text_key(F.col(text)), domain_of(F.col(source), domains).alias("domain"), F.col(lang).alias("lang"), F.col(source).alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("tokens"),
    )
    rows = stored(rows, "mixing-rows")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    for level in LEVELS:
        own = F.lit(1)
        for value, weight in weights.get(level, {}).items():
            own = F.when(F.col(level) == value, weight).otherwise(own)
        leaves = leaves.withColumn(f"{level}_weight", own)
    leaves = stored(leaves, "mixing-leaves")
    budget = int((leaves.agg(F.sum("tokens")).first()[0] or 0) * share)
    budgets = leaf_budgets(leaves, budget, epochs)
    held = leaves.alias("a").join(budgets.alias("b"), reduce(Column.__and__, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in LEVELS]))
    held = stored(held.select(*[F.col(f"a.{c}") for c in LEVELS], "tokens", "budget"), "mixing-budgets")
    return select_prefixes(rows, held, seed)


def domain_of(source: Column, domains: int) -> Column:
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"([0-9]{1,9})$", 1)
    return F.when(number == "", "other").otherwise(F.concat(F.lit("domain"), F.when(number != "", number).cast("bigint") % domains))


def take(docs: DataFrame, taken: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` (all columns) once per row of ``taken`` with its doc_id and text."""
    copies = taken.groupBy("doc_id", "_t1", "_t2", "epoch").agg(F.lit(1).alias("one")).groupBy("doc_id", "_t1", "_t2").agg(F.count("one").cast("int").alias("n"))
    copies = stored(copies.select(F.col("doc_id").alias("_id"), F.col("_t1").alias("_k1"), F.col("_t2").alias("_k2"), "n"), "mixing-taken")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(doc_id).alias("_own"), *text_key(F.col(text)))
    same = (rows["_t1"] == copies["_k1"]) & (rows["_t2"] == copies["_k2"]) & rows["_own"].eqNullSafe(copies["_id"])
    return rows.join(copies, same).select("_row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("_row.*")

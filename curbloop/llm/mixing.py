"""Mixing sources to target weights by hierarchical budgets.

The tree is domain -> language -> source. Weights are shared out from the root; what a child cannot take (its tokens times
the most epochs allowed) goes to its siblings first, and only what all of them cannot take goes back to the level above,
because every node is offered no more than its leaves can hold. A leaf then gives whole documents from a seeded order of
each epoch until its budget is reached.

Defined results: a null source or language is a node of its own. Nodes without a weight get ``default_weight``; those of
weight 0 give nothing. A null text has no tokens and follows its leaf's
whole epochs. Every row counts, also repeated ones; rows that tie in the seeded order
(same id) are taken one after another. Other columns are kept; those named like a result are replaced.
"""
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from curbloop.operators.layout import skew_join
from curbloop.operators.scratch import stage

LEVELS = ("domain", "lang", "source")


def word_tokens(text="text") -> Column:
    """Tokens as the mix counts them: words between white space."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def share_out(children: DataFrame, parent: list, budget="budget", cap="cap", weight="weight") -> DataFrame:
    """Add ``given``: the parent's budget in proportion to weights, no child above its cap, what is over to the others.

    In ascending order of cap / weight the children before some point are full and the rest share what is left in proportion to
    weight; the point is the first child whose share, with all before it full, stays within its cap (later
    ones would give a lower rate). All
    arithmetic is of whole numbers, so budgets times weights must stay below 2 ** 63."""
    w = W.partitionBy(*parent).orderBy(F.col(cap) / F.col(weight), *[c for c in LEVELS if c in children.columns])
    before = w.rowsBetween(W.unboundedPreceding, -1)
    everyone = W.partitionBy(*parent)
    rows = children.withColumns({
        "_full": F.coalesce(F.sum(cap).over(before), F.lit(0)),
        "_weight_left": F.sum(weight).over(everyone) - F.coalesce(F.sum(weight).over(before), F.lit(0))})
    left = F.col(budget) - F.col("_full")
    rate = F.struct((left / F.col("_weight_left")).alias("r"), left.alias("n"), F.col("_weight_left").alias("d"))
    rows = rows.withColumn("_rate", F.when(left * F.col(weight) <= F.col(cap) * F.col("_weight_left"), rate))
    rows = rows.withColumn("_rate", F.max("_rate").over(everyone))
    given = F.when(F.col("_rate").isNull(), F.col(cap)).otherwise(
        F.least(F.col(cap), F.expr(f"_rate.n * {weight} div _rate.d")))
    return rows.withColumn("given", F.greatest(given, F.lit(0))).drop("_full", "_weight_left", "_rate")


def budgets(leaves: DataFrame, weights: DataFrame, total: int, max_epochs: int, default_weight: int = 1) -> DataFrame:
    """``leaves``: (domain, lang, source, tokens, docs). ``weights``: (domain, lang, source, weight), null below the level that a weight is
    for. Returns the leaves with ``budget`` in tokens."""
    def weighted(rows, level):
        """Rows with the weight of their node of a level, without those of weight 0."""
        own = weights.filter(f"{level[-1]} is not null" + "".join(f" and {c} is null" for c in LEVELS[len(level):]))
        own = own.select(*[F.col(c).alias(f"_{c}") for c in level], "weight")
        return rows.join(own, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in level], "left").select(
            *rows.columns, F.coalesce(F.col("weight"), F.lit(default_weight)).cast("long").alias("weight")).filter("weight > 0")

    nodes = leaves.filter("tokens > 0").withColumn("cap", F.col("tokens") * max_epochs)
    for depth in range(1, len(LEVELS) + 1):  # nobody is offered what lies below a weight of 0
        nodes = weighted(nodes, list(LEVELS[:depth])).drop("weight")
    offered = nodes.agg(F.coalesce(F.least(F.lit(total), F.sum("cap")), F.lit(0)).cast("long").alias("budget"))
    parents, above = offered, []
    for depth in range(1, len(LEVELS) + 1):
        level = list(LEVELS[:depth])
        named = weighted(nodes.groupBy(*level).agg(F.sum("cap").alias("cap")), level)
        if above:
            named = named.join(parents, [named[c].eqNullSafe(parents[f"_{c}"]) for c in above]).drop(*[f"_{c}" for c in above])
        else:
            named = named.crossJoin(F.broadcast(parents))  # one row: the whole budget
        given = share_out(named, above)
        parents = given.select(*[F.col(c).alias(f"_{c}") for c in level], F.col("given").alias("budget"))
        above = level
    kept = leaves.join(parents, [leaves[c].eqNullSafe(parents[f"_{c}"]) for c in LEVELS], "left").drop(*[f"_{c}" for c in LEVELS])
    return kept.withColumn("budget", F.coalesce("budget", F.lit(0)))


def seeded(seed: int, epoch: Column, doc_id: Column) -> Column:
    """The order of an epoch: a digest of seed, epoch and id."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def mix(docs: DataFrame, weights: DataFrame, domain: Column, total: int | None = None, max_epochs: int = 4, seed: int = 7, doc_id="doc_id",
        lang="lang", source="source", tokens: Column | None = None, small: int = 50_000, digits: int = 3) -> DataFrame:
    """Rows of ``docs`` once per epoch they are taken in: their columns, ``domain``, ``tokens`` and ``epoch`` from 0.

    ``total`` tokens are asked for: those at hand by default. ``digits`` hex digits of the seeded order make the parts in which running
    sums are taken, so a leaf of any size is spread over 16 ** digits parts."""
    results = {"domain", "tokens", "epoch", "_lang", "_source", "_whole", "_part", "_order", "_left", "_before", "_sum", "_copies"}
    kept = [c for c in docs.columns if c not in results]
    rows = docs.withColumns({"tokens": word_tokens() if tokens is None else tokens, "domain": domain})
    rows = rows.select(*kept, "domain", "tokens", F.col(lang).alias("_lang"), F.col(source).alias("_source"))
    leaves = stage(rows.groupBy("domain", F.col("_lang").alias("lang"), F.col("_source").alias("source"))
                   .agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "mix-leaves")
    if total is None:
        total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    asked = budgets(leaves, weights, total, max_epochs)
    asked = stage(asked.select(
        _leaf("domain", "lang", "source").alias("_leaf"), F.expr("if(tokens > 0, budget div tokens, 0)").alias("_whole"),
        F.expr("if(tokens > 0, budget % tokens, 0)").alias("_left")), "mix-budgets")
    rows = rows.withColumn("_leaf", _leaf("domain", "_lang", "_source")).drop("_lang", "_source")
    if asked.limit(small + 1).count() <= small:
        rows = rows.join(F.broadcast(asked), "_leaf")
    else:
        rows = skew_join(rows, asked, ["_leaf"], [doc_id])
    rows = rows.withColumn("_order", seeded(seed, F.col("_whole"), F.col(doc_id)))
    rows = rows.withColumn("_part", F.substring("_order", 1, digits))
    parts = rows.groupBy("_leaf", "_part").agg(F.sum("tokens").alias("n"))
    before = W.partitionBy("_leaf").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row per part
    parts = parts.select("_leaf", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy("_leaf", "_part").orderBy("_order").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_sum", F.sum("tokens").over(inside)).join(parts, ["_leaf", "_part"])
    more = (F.col("tokens") > 0) & (F.col("_before") + F.col("_sum") <= F.col("_left"))
    rows = rows.withColumn("_copies", F.col("_whole") + more.cast("long"))
    return (rows.filter("_copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
            .select(*kept, "domain", "tokens", "epoch"))


def _leaf(domain, lang, source) -> Column:
    """One comparable key per leaf, nulls included."""
    return F.to_json(F.array(*[F.col(c).cast("string") for c in (domain, lang, source)]))

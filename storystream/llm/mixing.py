"""Mixing sources to target weights, by hierarchical budgets.

A token budget is handed down a tree of domains, languages and sources. At each
node the children share it by weight; a child that cannot use its share (its
whole subtree, over all epochs, holds fewer tokens) takes what it can, and the
rest goes to its siblings. As a node never gets more than its subtree holds, a
shortage is met among siblings first and climbs only when all of them are used
up. Each leaf then takes the prefix of its seeded order - epoch after epoch, each
in an order of its own - that its budget pays for.

Only column expressions are used. Rows are ordered by a hash, and the hash is cut
into ranges of a bounded number of rows: ranges beyond the budget are left out by
their sums, and rows are ordered inside their range only, so a leaf with a third of
all rows is never sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storystream.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
LEVELS = ("domain", "lang", "source")
#: Weight of a child beside its siblings, by level and name; 1 where it is not named
WEIGHTS = {
    "domain": {"crawl": 3.0, "curated": 5.0, "other": 2.0},
    "lang": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0},
    "source": {},
}
#: The budget as a part of all tokens, and how often a document may be used
BUDGET = 0.6
EPOCHS = 2
SEED = 7
#: About so many rows of a leaf fall into one range of its order
RANGE_ROWS = 4096
HASH_BITS = 40


def domain_of(source: Column) -> Column:
    """Domain of a source: `src0` is crawled, the other numbered ones are curated."""
    return (
        F.when(source == "src0", "crawl")
        .when(source.rlike(r"^src[0-9]+$"), "curated")
        .otherwise("other")
    )


def tokens_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def _weight(level: str, weights: dict[str, dict[str, float]]) -> Column:
    weight = F.lit(1.0)
    for name, value in weights.get(level, {}).items():
        if not value >= 0:
            raise ValueError(f"the weight of {level} {name} must be 0 or more")
        weight = F.when(F.col(level) == name, float(value)).otherwise(weight)
    return weight


def share_out(nodes: DataFrame, parent: list[str], level: str, budget: str, capacity: str) -> DataFrame:
    """Split `budget` among siblings by `weight`, none above its `capacity`, as column `allotted`.

    Siblings are taken in the order in which they run short (capacity per
    weight). One runs short if, of what the earlier ones leave, its share by
    weight exceeds its capacity; it then gets its capacity, and the others share
    the rest. Their part per weight is that of the first that does not. A child of
    weight 0 gets nothing.
    """
    weighs = F.col("weight") > 0
    usable = F.when(weighs, F.col(capacity)).otherwise(0)
    siblings = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    ordered = siblings.orderBy(F.coalesce(F.try_divide(usable, F.col("weight")), F.lit(0.0)), level)
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    onward = ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_of_them = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rate = F.try_divide(F.col(budget) - F.col("_used"), F.col("_left"))
    return (
        nodes.withColumn("_used", F.coalesce(F.sum(usable).over(earlier), F.lit(0)))
        .withColumn("_left", F.sum("weight").over(onward))
        .withColumn("_rate", F.when(weighs & (rate * F.col("weight") <= usable), rate))
        .withColumn("_level", F.first("_rate", ignorenulls=True).over(all_of_them))
        .withColumn("allotted", F.coalesce(F.least(F.floor(F.col("_level") * F.col("weight")), usable), usable))
        .drop("_used", "_left", "_rate", "_level")
    )


def budgets(leaves: DataFrame, weights: dict, budget: float, epochs: int) -> DataFrame:
    """Rows (domain, lang, source, tokens, rows, allotted) of leaves; a leaf is a row per source, not per document.

    What lies below a weight of 0 can use nothing, so that its ancestors' other
    children take up the whole budget.
    """
    open_leaf = F.lit(True)
    for name in LEVELS:
        open_leaf = open_leaf & (_weight(name, weights) > 0)
    level = leaves.withColumn("capacity", F.when(open_leaf, F.col("tokens") * epochs).otherwise(0).cast("bigint"))
    nodes = (
        level.groupBy("domain").agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"))
        .withColumn("weight", _weight("domain", weights))
    )
    whole = Window.partitionBy(F.lit(0))
    nodes = nodes.withColumn("budget", F.floor(F.sum("tokens").over(whole) * F.lit(float(budget))))
    nodes = share_out(nodes, [], "domain", "budget", "capacity").select(
        "domain", F.col("allotted").alias("budget")
    )
    langs = level.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity"))
    langs = langs.withColumn("weight", _weight("lang", weights)).join(nodes, "domain")
    langs = share_out(langs, ["domain"], "lang", "budget", "capacity").select(
        "domain", "lang", F.col("allotted").alias("budget")
    )
    sources = level.withColumn("weight", _weight("source", weights)).join(langs, ["domain", "lang"])
    return share_out(sources, ["domain", "lang"], "source", "budget", "capacity").select(
        *LEVELS, "tokens", "rows", "allotted"
    )


def _rows(docs: DataFrame) -> list[Column]:
    source = F.coalesce(F.col("source"), F.lit("unknown"))
    return [
        F.col("doc_id"),
        domain_of(source).alias("domain"),
        F.coalesce("lang", F.lit("unknown")).alias("lang"),
        source.alias("source"),
        tokens_of(F.col("text")).alias("tokens"),
        F.xxhash64("text").alias("text_hash"),
    ]


def _place(rows: DataFrame, per_leaf: DataFrame, epochs: int, seed: int) -> DataFrame:
    """A row per use that a leaf's budget may reach, with its place in the leaf's order."""
    mixed = F.xxhash64(F.lit(seed), "epoch", "doc_id", "text_hash")
    return (
        rows.join(per_leaf, list(LEVELS))
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
        .withColumn("_rest", F.col("allotted") - F.col("epoch") * F.col("leaf_tokens"))
        .where("_rest > 0")
        .withColumn("_order", F.shiftrightunsigned(mixed, 64 - HASH_BITS))
        .withColumn("_range", F.floor(F.col("_order") * F.col("ranges") / F.lit(2.0**HASH_BITS)))
    )


def _choose(docs: DataFrame, weights: dict, budget: float, epochs: int, seed: int, whole: bool) -> DataFrame:
    narrow = materialize(docs.select(_rows(docs)), "mix-rows")
    leaves = narrow.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    ranges = F.pow(2.0, F.ceil(F.log2(F.col("rows") / RANGE_ROWS)))
    per_leaf = budgets(leaves, weights, budget, epochs).select(
        *LEVELS, "allotted",
        F.col("tokens").alias("leaf_tokens"),
        F.greatest(F.lit(1.0), ranges).cast("bigint").alias("ranges"),
    )
    # Written, so that Spark knows how small it is before it plans the joins with all rows
    per_leaf = materialize(per_leaf, "mix-budgets")
    leaf = [*LEVELS, "epoch"]
    sums = (
        _place(narrow, per_leaf, epochs, seed)
        .groupBy(*leaf, "_range")
        .agg(F.sum("tokens").alias("_sum"), F.min("_rest").alias("_limit"))
    )
    before = Window.partitionBy(*leaf).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    reached = materialize(
        sums.withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .where("_start < _limit")
        .select(*leaf, "_range", "_start"),
        "mix-ranges",
    )
    rows = docs.select(*_rows(docs), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc")) if whole else narrow
    within = Window.partitionBy(*leaf, "_range").orderBy("_order", "doc_id", "text_hash")
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    return (
        _place(rows, per_leaf, epochs, seed)
        .join(reached, [*leaf, "_range"])
        .withColumn("_here", F.col("_start") + F.coalesce(F.sum("tokens").over(earlier), F.lit(0)))
        .where("_here < _rest")
    )


def mix(
    docs: DataFrame,
    weights: dict = WEIGHTS,
    budget: float = BUDGET,
    epochs: int = EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """Rows (doc_id, epoch, domain, lang, source, tokens, position, allotted), one per use of a document.

    `position` is the number of tokens that the leaf takes before the row; a row
    is taken if its first token lies within the leaf's budget, so a leaf exceeds
    its budget by less than one document, and one with any budget is not empty.
    Null lang and source count as 'unknown'. Null and empty texts have no tokens:
    they are taken if their place lies before the budget's end. Rows equal in id and text are uses of their own,
    in any order. A domain, language or source of weight 0 is left out, and its
    share goes to its siblings; a budget that no child of any weight above 0 can
    use is not spent. Other columns are ignored; an empty table gives no rows.
    """
    return _choose(docs, weights, budget, epochs, seed, False).select(
        "doc_id", "epoch", *LEVELS, "tokens",
        (F.col("epoch") * F.col("leaf_tokens") + F.col("_here")).alias("position"),
        "allotted",
    )


def mix_documents(
    docs: DataFrame,
    weights: dict = WEIGHTS,
    budget: float = BUDGET,
    epochs: int = 1,
    seed: int = SEED,
) -> DataFrame:
    """The chosen rows of `docs`, all columns as they are, as often as they are used; edge cases are those of `mix`."""
    return _choose(docs, weights, budget, epochs, seed, True).select("_doc.*")

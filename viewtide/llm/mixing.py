"""Mixing sources to target weights by hierarchical budgets.

Leaves are the sources of a language of a domain; ``Tree`` says which domain a source is in, and the nodes' target weights
against their siblings. A leaf can give its tokens - pieces of a public vocabulary - up to ``max_epochs`` times. The budget goes
down the tree: each node's budget is divided among its children by weight, where none gets more than the leaves below it can
give; what a child can't take goes to its siblings, by weight again, until all of them are full. A node as a whole lacks
tokens only when all below it are full, so shortages are met by siblings before they reach the level above.

The division has a closed form: below some level every child is full, and the others get weight times that level. The level of
a parent is looked for in a histogram of its children's capacity over weight, and within one of its bins by the children
themselves, so a parent of very many sources isn't put in order in one task.

A leaf's stream is its epochs one after another, each a permutation of its documents by a seeded hash; the leaf gets the
stream's longest prefix within its budget, so a document is chosen as often as whole epochs fit, and once more if it lies
in the prefix of the last one. The prefix's end is found digit by digit of the hash: sums of tokens by the next ``DIGIT_BITS``
bits tell which range of hashes holds it, and only that range is read again. A row's copies follow from its own hash and its
leaf's range, so texts are neither moved nor joined; only rows within the last range, few for each leaf, are looked up.

Defined results: a null text has no tokens, and empty texts are never chosen; a null source or lang is a node of its own,
named ``?``; documents of one leaf with equal doc_id and text are chosen alike and count each time, others are told apart also
where they have the same doc_id or none; the prefix ends before the first hash whose documents don't fit; a node of weight
zero gets nothing; a very long text counts whole; an empty table gives no rows; other columns of docs may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import around_extras, cut, rows_of, small_or_plain, text_batches, text_or_empty
from .token_counts import MODEL, count_texts

SEED = 20_26
#: Bits of the hash that one pass looks at, of all its bits, and rows of a leaf that may be put in order.
DIGIT_BITS, HASH_BITS, ORDERED_ROWS = 10, 62, 1_000
#: Bins of the histogram of capacity over weight for each power of two.
BINS = 32
#: A node without a target weight weighs its tokens to this power, so small sources count for more than their size.
SMOOTHING = 0.7
LEVELS = ("mix_domain", "mix_lang", "mix_source")


@dataclass(frozen=True)
class Tree:
    """domains: a domain's sources; all others are in the domain ``other``. weights: by path, ("web",), ("web", "en") or ("web", "en", "src3")."""

    domains: dict[str, tuple[str, ...]] = field(default_factory=dict)
    weights: dict[tuple[str, ...], float] = field(default_factory=dict)

    def domain_of(self, source: Column) -> Column:
        out = F.lit("other")
        for name, sources in self.domains.items():
            out = F.when(source.isin(*sources), F.lit(name)).otherwise(out)
        return out

    def weight(self, depth: int) -> Column:
        out = F.pow(F.col("mix_tokens").cast("double"), F.lit(SMOOTHING))
        for path, value in self.weights.items():
            if len(path) == depth:
                same = F.lit(True)
                for column, name in zip(LEVELS, path, strict=False):
                    same = same & (F.col(column) == name)
                out = F.when(same, F.lit(float(value))).otherwise(out)
        return out


def divide(children: DataFrame, parent: list[str]) -> DataFrame:
    """children (parent columns, mix_weight, mix_capacity, mix_total) -> with mix_budget, at most the capacity of each."""
    parent = ["mix_root", *parent]
    w, c, by = F.col("mix_weight"), F.col("mix_capacity"), Window.partitionBy(*parent)
    rows = children.withColumn("mix_root", F.lit(0)).withColumn("mix_ratio", F.when((w > 0) & (c > 0), c / w).otherwise(F.lit(0.0)))
    rows = cut(rows.withColumn("mix_bin", F.when(F.col("mix_ratio") > 0, F.floor(F.log2("mix_ratio") * BINS).cast("int")).otherwise(F.lit(-(2**31) + 1))))
    weighty = rows.where("mix_weight > 0 and mix_capacity > 0")
    bins = weighty.groupBy(*parent, "mix_bin").agg(F.sum("mix_weight").alias("bin_weight"), F.sum("mix_capacity").alias("bin_capacity"), F.first("mix_total").alias("mix_total"))
    turn = by.orderBy("mix_bin")
    below, above = turn.rowsBetween(Window.unboundedPreceding, -1), turn.rowsBetween(1, Window.unboundedFollowing)
    bins = bins.withColumn("full_capacity", F.coalesce(F.sum("bin_capacity").over(below), F.lit(0.0))).withColumn("open_weight", F.coalesce(F.sum("bin_weight").over(above), F.lit(0.0)))
    # What all would take if the level were the bin's upper end.
    edge = F.pow(F.lit(2.0), (F.col("mix_bin") + 1) / BINS)
    bins = bins.where(F.col("full_capacity") + F.col("bin_capacity") + edge * F.col("open_weight") > F.col("mix_total"))
    first = bins.groupBy(*parent).agg(F.min_by(F.struct("mix_bin", "full_capacity", "open_weight"), "mix_bin").alias("b")).select(*parent, "b.*")
    # Within that bin, children in the order of their ratio are full until one's share at its turn is less than its capacity.
    inside = weighty.join(first, [*parent, "mix_bin"])
    turn = by.orderBy("mix_ratio")
    sums = inside.groupBy(*parent, "mix_ratio", "full_capacity", "open_weight", "mix_total").agg(F.sum("mix_weight").alias("r_weight"), F.sum("mix_capacity").alias("r_capacity"))
    before, rest = turn.rowsBetween(Window.unboundedPreceding, -1), turn.rowsBetween(0, Window.unboundedFollowing)
    share = (F.col("mix_total") - F.col("full_capacity") - F.coalesce(F.sum("r_capacity").over(before), F.lit(0.0))) / (F.col("open_weight") + F.sum("r_weight").over(rest))
    last = (F.col("mix_total") - F.col("full_capacity") - F.sum("r_capacity").over(by)) / F.col("open_weight")
    sums = sums.withColumn("share", share).withColumn("last", F.when(F.col("open_weight") > 0, last).otherwise(F.lit(float("inf"))))
    open_share = F.min_by("share", F.when(F.col("mix_ratio") > F.col("share"), F.col("mix_ratio")))
    levels = cut(sums.groupBy(*parent).agg(F.coalesce(open_share, F.max("last")).alias("mix_level")))
    done = rows.join(levels, parent, "left")
    budget = F.when((w <= 0) | (c <= 0), F.lit(0.0)).when(F.col("mix_level").isNull(), c).otherwise(F.greatest(F.lit(0.0), F.least(c, w * F.col("mix_level"))))
    return done.withColumn("mix_budget", budget).drop("mix_root", "mix_ratio", "mix_bin", "mix_level")


def budgets(leaves: DataFrame, share: float, max_epochs: int, tree: Tree) -> DataFrame:
    """leaves (mix_domain, mix_lang, mix_source, mix_tokens) -> the same with mix_budget in tokens; share: of all tokens once."""
    total = float(share) * (leaves.agg(F.sum("mix_tokens")).first()[0] or 0)
    nodes: list[DataFrame] = []
    for depth in range(1, len(LEVELS) + 1):
        rows = leaves.groupBy(*LEVELS[:depth]).agg(F.sum("mix_tokens").alias("mix_tokens"))
        nodes.append(rows.withColumn("mix_weight", tree.weight(depth)))
    # What the leaves below a node can give, but for those that a weight of zero shuts out.
    nodes[-1] = nodes[-1].withColumn("mix_capacity", F.when(F.col("mix_weight") > 0, F.col("mix_tokens") * float(max_epochs)).otherwise(F.lit(0.0)))
    for depth in range(len(LEVELS) - 1, 0, -1):
        below = nodes[depth].groupBy(*LEVELS[:depth]).agg(F.sum("mix_capacity").alias("mix_capacity"))
        nodes[depth - 1] = nodes[depth - 1].join(below, list(LEVELS[:depth])).withColumn("mix_capacity", F.when(F.col("mix_weight") > 0, F.col("mix_capacity")).otherwise(F.lit(0.0)))
    above: DataFrame | None = None
    for depth, rows in enumerate(nodes, 1):
        parent = list(LEVELS[: depth - 1])
        rows = rows.withColumn("mix_total", F.lit(total)) if above is None else rows.join(above, parent)
        done = divide(rows, parent)
        above = done.select(*LEVELS[:depth], F.col("mix_budget").alias("mix_total"))
    return done.select(*LEVELS, "mix_tokens", F.floor(F.round("mix_budget", 3)).cast("long").alias("mix_budget"))


def places(docs: DataFrame, tree: Tree) -> list[Column]:
    """A row's leaf, and the hash of its text that tells it from others of its doc_id."""
    source = F.coalesce(F.col("source"), F.lit("?"))
    return [tree.domain_of(source).alias("mix_domain"), F.coalesce(F.col("lang"), F.lit("?")).alias("mix_lang"), source.alias("mix_source"), F.xxhash64(text_or_empty()).alias("mix_text")]


def order_of(seed: int) -> Column:
    """A row's place in the permutation of its leaf's last epoch."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "mix_epochs", F.isnull("doc_id"), F.col("doc_id").cast("long"), "mix_text"), 64 - HASH_BITS)


def counted(docs: DataFrame, tree: Tree, model: str) -> DataFrame:
    """doc_id, the leaf, mix_text and mix_tokens of each row."""
    import pyarrow as pa

    text_batches(docs.sparkSession)
    names = ["doc_id", *LEVELS, "mix_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = count_texts([t or "" for (t,) in rows_of(batch, "text")], model)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(tokens, pa.int64())], [*names, "mix_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *places(docs, tree), "text")
    return rows.mapInArrow(run, "doc_id long, mix_domain string, mix_lang string, mix_source string, mix_text long, mix_tokens long")


def plan_of(rows: DataFrame, share: float, max_epochs: int, tree: Tree, seed: int) -> tuple[DataFrame, DataFrame]:
    """rows (counted) -> (a row for each leaf: mix_epochs, and the hashes mix_low and mix_high between which its prefix ends; the hashes between them that are in)."""
    leaf = list(LEVELS)
    leaves = cut(rows.groupBy(*leaf).agg(F.sum("mix_tokens").alias("mix_tokens")))
    epochs = F.when(F.col("mix_tokens") > 0, F.floor(F.col("mix_budget") / F.col("mix_tokens"))).otherwise(F.lit(0)).cast("long")
    plan = budgets(leaves, share, max_epochs, tree).select(*leaf, epochs.alias("mix_epochs"), (F.col("mix_budget") - epochs * F.col("mix_tokens")).alias("mix_rest"))
    # mix_low: where the range begins that holds the prefix's end; mix_rest: the tokens that are left at its beginning.
    plan = cut(plan.withColumn("mix_low", F.lit(0).cast("long")).withColumn("mix_high", F.lit(1 << HASH_BITS)))
    inside = cut(rows.where("mix_tokens > 0").join(small_or_plain(plan.select(*leaf, "mix_epochs")), leaf).select(*leaf, order_of(seed).alias("mix_order"), "mix_tokens"))
    bits = HASH_BITS
    while True:
        inside = inside.join(small_or_plain(plan.select(*leaf, "mix_low", "mix_high")), leaf).where("mix_order >= mix_low and mix_order < mix_high").select(*leaf, "mix_order", "mix_tokens")
        most = inside.groupBy(*leaf).count().agg(F.max("count")).first()[0] or 0
        if most <= ORDERED_ROWS or bits <= 2:
            break
        bits = max(0, bits - DIGIT_BITS)
        sums = inside.groupBy(*leaf, F.shiftright("mix_order", bits).alias("digit")).agg(F.sum("mix_tokens").alias("mix_sum"))
        so_far = F.sum("mix_sum").over(Window.partitionBy(*leaf).orderBy("digit"))
        ends = sums.withColumn("so_far", so_far).join(plan.select(*leaf, "mix_rest"), leaf).where("so_far > mix_rest")
        ends = ends.groupBy(*leaf).agg(F.min_by(F.struct("digit", (F.col("so_far") - F.col("mix_sum")).alias("before")), "digit").alias("e"))
        found = F.col("e").isNotNull()
        low = F.when(found, F.shiftleft(F.col("e.digit"), bits)).otherwise(F.col("mix_high"))
        high = F.when(found, F.shiftleft(F.col("e.digit") + 1, bits)).otherwise(F.col("mix_high"))
        rest = F.col("mix_rest") - F.coalesce(F.col("e.before"), F.lit(0))
        plan = cut(plan.join(ends, leaf, "left").select(*leaf, "mix_epochs", rest.alias("mix_rest"), low.alias("mix_low"), high.alias("mix_high")))
        inside = cut(inside)
    same = inside.groupBy(*leaf, "mix_order").agg(F.sum("mix_tokens").alias("mix_sum"))
    so_far = F.sum("mix_sum").over(Window.partitionBy(*leaf).orderBy("mix_order"))
    chosen = same.withColumn("so_far", so_far).join(plan.select(*leaf, "mix_rest"), leaf).where("so_far <= mix_rest").select(*leaf, "mix_order", F.lit(True).alias("mix_in"))
    return plan.select(*leaf, "mix_epochs", "mix_low", "mix_high"), cut(chosen)


def with_copies(rows: DataFrame, plan: DataFrame, chosen: DataFrame, some: Column, seed: int) -> DataFrame:
    """rows with mix_copies; some: whether a row has tokens at all."""
    leaf = list(LEVELS)
    rows = rows.join(small_or_plain(plan), leaf).withColumn("mix_order", order_of(seed))
    rows = rows.join(small_or_plain(chosen), [*leaf, "mix_order"], "left")
    once_more = (F.col("mix_order") < F.col("mix_low")) | F.coalesce("mix_in", F.lit(False))
    return rows.withColumn("mix_copies", F.when(some, F.col("mix_epochs") + once_more.cast("long")).otherwise(F.lit(0).cast("long")))


def choices(docs: DataFrame, share: float = 0.9, max_epochs: int = 2, tree: Tree | None = None, seed: int = SEED, model: str = MODEL) -> DataFrame:
    """A row for each row of docs: doc_id, mix_domain, mix_lang, mix_source, mix_tokens, mix_copies."""
    tree = tree or Tree()
    rows = cut(counted(docs, tree, model))
    plan, chosen = plan_of(rows, share, max_epochs, tree, seed)
    return with_copies(rows, plan, chosen, F.col("mix_tokens") > 0, seed).select("doc_id", *LEVELS, "mix_tokens", "mix_copies")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs as often as they are chosen, with docs' columns."""
    return around_extras(docs, {"doc_id", "text", "lang", "source"}, lambda d: _mixed(d, **how))


def _mixed(docs: DataFrame, share: float = 0.9, max_epochs: int = 2, tree: Tree | None = None, seed: int = SEED, model: str = MODEL) -> DataFrame:
    tree = tree or Tree()
    plan, chosen = plan_of(cut(counted(docs, tree, model)), share, max_epochs, tree, seed)
    rows = with_copies(docs.select("*", *places(docs, tree)), plan, chosen, F.length(text_or_empty()) > 0, seed)
    repeated = rows.where("mix_copies > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies"))))
    return repeated.select(*docs.columns)

"""Mixing sources to target weights by hierarchical budgeting.

A tree of domains, languages and sources has whole-number weights at every level. A budget of tokens
is handed down level by level in proportion to the weights; a child that cannot use its share, even
with all its epochs, takes what it can hold, and the rest goes to its siblings before anything goes
back to its parent's. A leaf then takes a prefix of its epochs: whole ones first, and of the next one,
in an order seeded by its number, the documents whose running total of tokens stays in the budget.

Running totals have two levels, so no task sorts a leaf: totals of 4096 ranges of the order, and the
documents of the one range in which the budget ends.

A null language or source is the leaf 'unknown'; a null text has no tokens. Rows that repeat a doc_id
in a leaf are taken or left together, a null doc_id being one of them. No rows give no rows. Weights
are at most 1000, and one of 0 leaves a subtree out. All steps are DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..operators.durable import written_once
from .tables import text_of

LEVELS = ("domain", "lang", "source")
RANGES = 4_096  # three hexadecimal digits of the order
UNKNOWN = "unknown"


@dataclass(frozen=True)
class Targets:
    """Weights by name at each level (others count 1), and the budget as a share of all tokens in percent."""

    domains: Mapping[str, int] = field(default_factory=dict)
    langs: Mapping[str, int] = field(default_factory=dict)
    sources: Mapping[str, int] = field(default_factory=dict)
    budget_percent: int = 100
    max_epochs: int = 2
    seed: int = 1


def n_tokens(text: Column) -> Column:
    """Words, which is what budgets are counted in unless a column of counts is given."""
    return F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def domain_of_source(source: Column) -> Column:
    """d0 to d3 from the number a source's name ends in."""
    number = F.try_to_number(F.nullif(F.regexp_extract(source, "([0-9]{1,9})$", 1), F.lit("")), F.lit("999999999")).cast("long")
    return F.coalesce(F.concat(F.lit("d"), F.pmod(number, F.lit(4)).cast("string")), F.lit(UNKNOWN))


def _weight(name: Column, weights: Mapping[str, int]) -> Column:
    value = F.lit(1).cast("long")
    for key, weight in weights.items():
        if not 0 <= weight <= 1000:
            raise ValueError("weights are whole numbers from 0 to 1000")
        value = F.when(name == key, F.lit(weight).cast("long")).otherwise(value)
    return value


def shared_out(children: DataFrame, parents: list[str], child: str) -> DataFrame:
    """Adds `share`: the parent's `budget` over rows (parents, child, weight, room), none over its room.

    Children fill up in the order of room per weight. One fills up if its part of what is left is at
    least its room; those after the first that does not fill up divide the rest by weight.
    """
    in_order = W.partitionBy(*parents).orderBy(F.col("room") / F.col("weight"), child)
    whole = W.partitionBy(*parents)
    before = F.coalesce(F.sum("room").over(in_order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ahead = F.sum("weight").over(in_order.rowsBetween(W.currentRow, W.unboundedFollowing))
    fills = children.withColumn("_fits", F.col("room") * ahead <= (F.col("budget") - before) * F.col("weight"))
    fills = fills.withColumn("_full", F.every("_fits").over(in_order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    left = F.col("budget") - F.sum(F.when(F.col("_full"), F.col("room")).otherwise(0)).over(whole)
    weights = F.sum(F.when(F.col("_full"), 0).otherwise(F.col("weight"))).over(whole)
    part = fills.withColumn("_left", left).withColumn("_weights", weights)
    share = F.when(F.col("_full"), F.col("room")).otherwise(F.expr("(_left * weight) div _weights"))
    return part.withColumn("share", share).drop("_fits", "_full", "_left", "_weights")


def leaf_budgets(leaves: DataFrame, targets: Targets) -> DataFrame:
    """(domain, lang, source, tokens, budget) from rows (domain, lang, source, tokens)."""
    weights = {"domain": targets.domains, "lang": targets.langs, "source": targets.sources}
    counted = leaves.where(F.col("tokens") > 0)
    for level in LEVELS:
        counted = counted.withColumn(f"w_{level}", _weight(F.col(level), weights[level])).where(f"w_{level} > 0")
    everything = W.partitionBy("root")
    counted = counted.withColumn("root", F.lit(0)).withColumn("leaf_room", F.col("tokens") * targets.max_epochs)
    current = counted.withColumn("total", F.sum("tokens").over(everything))
    current = current.withColumn("budget", F.expr(f"(total * {targets.budget_percent}) div 100"))
    parents = ["root"]
    for level in LEVELS:
        nodes = current.groupBy(*parents, level).agg(
            F.first(f"w_{level}").alias("weight"), F.sum("leaf_room").alias("room"), F.first("budget").alias("budget")
        )
        shares = shared_out(nodes, parents, level).select(*parents, level, F.col("share").alias("_share"))
        parents = [*parents, level]
        current = current.join(shares, parents).withColumn("budget", F.col("_share")).drop("_share")
    return current.select(*LEVELS, "tokens", F.col("budget").cast("long").alias("budget"))


def _leaf(domain: Column | None) -> list[Column]:
    """Leaf columns of documents: names that are null are 'unknown'."""
    return [
        (domain_of_source(F.col("source")) if domain is None else F.coalesce(domain, F.lit(UNKNOWN))).alias("domain"),
        F.coalesce(F.col("lang"), F.lit(UNKNOWN)).alias("lang"),
        F.coalesce(F.col("source"), F.lit(UNKNOWN)).alias("source"),
    ]


def chosen(docs: DataFrame, targets: Targets, domain: Column | None = None, tokens: Column | None = None) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, epoch): the documents taken, once for each epoch they are taken in."""
    count = n_tokens(text_of()) if tokens is None else F.coalesce(tokens, F.lit(0)).cast("long")
    rows = docs.select("doc_id", *_leaf(domain), count.alias("n"))
    rows = written_once(rows.groupBy("doc_id", *LEVELS).agg(F.sum("n").alias("n_tokens")), "leaf-documents")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    budgets = written_once(leaf_budgets(leaves, targets), "leaf-budgets")
    epochs = F.expr("budget div tokens")
    planned = rows.join(budgets, list(LEVELS)).withColumn("whole", epochs).withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens"))
    complete = planned.where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), "whole")))

    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    order = F.sha2(F.concat_ws(":", F.lit(str(targets.seed)), (F.col("whole") + 1).cast("string"), name), 256)
    partial = planned.where("rest > 0").withColumn("order", order).withColumn("range", F.left("order", F.lit(3)))
    totals = partial.groupBy(*LEVELS, "range").agg(F.sum("n_tokens").alias("in_range"), F.first("rest").alias("limit"))
    up_to = W.partitionBy(*LEVELS).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumn("before", F.coalesce(F.sum("in_range").over(up_to), F.lit(0))).where("before <= limit")
    ranges = written_once(totals.select(*LEVELS, "range", "before", "in_range"), "leaf-ranges")
    placed = partial.join(ranges, [*LEVELS, "range"])
    inside = placed.where("before + in_range <= rest")
    running = W.partitionBy(*LEVELS, "range").orderBy("order", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    split = placed.where("before + in_range > rest").withColumn("upto", F.col("before") + F.sum("n_tokens").over(running)).where("upto <= rest")
    started = inside.unionByName(split.drop("upto")).withColumn("epoch", F.col("whole") + 1)
    wanted = ["doc_id", *LEVELS, "n_tokens", "epoch"]
    return complete.select(*wanted).unionByName(started.select(*wanted))


def mixed(docs: DataFrame, targets: Targets, domain: Column | None = None) -> DataFrame:
    """The rows of docs that are taken, once for each epoch, with their columns."""
    taken = chosen(docs, targets, domain)
    leaf = [c.alias(f"{name}_of") for c, name in zip(_leaf(domain), LEVELS)]
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id_of"), *leaf)
    same = F.col("id_of").eqNullSafe(F.col("doc_id"))
    for level in LEVELS:
        same = same & (F.col(f"{level}_of") == F.col(level))
    # What is taken grows with the documents, so it is not sent to all tasks.
    return rows.join(taken.hint("merge"), same).select("row.*")

"""Context packs: what an assistant is told about some entities, within a budget of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import token_estimate
from .graph import reach, rooted, routes, steps_of

# Budgets by name, and the sections in their order.
BUDGETS = {"small": 8_000, "medium": 16_000, "large": 32_000}
SECTIONS = ("focal", "dependency_signature", "transitive", "contract", "test", "work", "note", "traffic")


def context_pack(focal: DataFrame, entities: DataFrame, relations: DataFrame, extras: DataFrame, budget: int | str = "small", depth: int = 2, reserve: int = 0) -> DataFrame:
    """(root, section, id, tokens, total) of focal entities (id), a pack for each; total: tokens up to and with the entry.

    focal: the entity with its body; dependency_signature: what it depends on directly, by signature; transitive: what these
    depend on within depth steps, by name and kind; then extras (section, id, about, text): contracts, tests, work items,
    notes and traffic about an entity of the pack. Sections are filled in order, the nearest first, ids break ties; an entry
    that no longer fits ends the pack. entities (id, kind, name, signature, body).
    """
    most = (BUDGETS[budget] if isinstance(budget, str) else budget) - reserve
    got = reach(rooted(focal.join(entities, "id", "left_semi")), steps_of(relations), depth, stored=True).join(entities.withColumnRenamed("id", "node"), "node")
    section = F.when(F.col("hop") == 0, "focal").when(F.col("hop") == 1, "dependency_signature").otherwise("transitive")
    text = F.when(F.col("hop") == 0, F.coalesce("body", "signature")).when(F.col("hop") == 1, F.col("signature")).otherwise(F.concat_ws(" ", "kind", "name"))
    own = got.select("root", section.alias("section"), F.col("node").alias("id"), "hop", text.alias("text"))
    near = got.where("hop < 2").select("root", F.col("node").alias("about"), "hop")
    more = extras.join(near, "about").groupBy("root", "section", "id").agg(F.min("hop").alias("hop"), F.min("text").alias("text"))
    rows = own.unionByName(more.select(*own.columns))
    order = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("section"))
    rows = rows.select("root", "section", "id", order.alias("order"), "hop", F.greatest(token_estimate(F.coalesce("text", F.lit(""))), F.lit(1)).cast("long").alias("tokens"))
    by = Window.partitionBy("root").orderBy("order", "hop", "id")
    first = rows.withColumn("n", F.row_number().over(by)).where(F.col("n") <= most)  # an entry takes a token at least
    total = first.withColumn("total", F.sum("tokens").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return total.where(F.col("total") <= most).select("root", "section", "id", "tokens", "total")


def focal_routes(focal: DataFrame, relations: DataFrame, hops: int = 4, each: int = 1) -> DataFrame:
    """(root, goal, hops, path): the shortest routes between every two of a bounded set of focal entities (id), both ways, in one search."""
    goals = focal.select(F.col("id").alias("goal"))
    pairs = focal.select(F.col("id").alias("root")).join(F.broadcast(goals)).where("root <> goal")  # a few entities that a user has named
    return routes(pairs, relations, hops, each)

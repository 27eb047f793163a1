"""Counts, histograms, coverage, co-change and sampling for export."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import module_of
from ..sources.store import dealt, rows_read


def histogram(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value, n) of several columns in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])
    return rows.select(F.explode(pairs).alias("p")).groupBy("p.facet", "p.value").agg(F.count("*").alias("n"))


def overview(entities: DataFrame, relations: DataFrame) -> DataFrame:
    a = entities.agg(F.count("*").alias("entities"), F.count_distinct("file").alias("files"), F.count_distinct("kind").alias("kinds"), F.count_distinct("language").alias("languages"))
    return a.join(F.broadcast(relations.agg(F.count_distinct("id").alias("relations"))))  # one row each


def degrees(relations: DataFrame, kinds=None) -> DataFrame:
    """(id, degree) over distinct undirected links of one kind; a node's are counted as they come, not held."""
    if kinds:
        relations = relations.where(F.col("kind").isin(*kinds))
    n = rows_read(relations)
    links = dealt(relations.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "kind"), "a", "b", rows=n).distinct()
    return dealt(links.select(F.explode(F.array("a", "b")).alias("id")), "id", rows=n).groupBy("id").agg(F.count("*").alias("degree"))


def partners(relations: DataFrame, end: str, other: str, name: str) -> DataFrame:
    """(id, name): with how many distinct `other` ends each node is an `end` of relations."""
    return dealt(relations.select(end, other), end, other).groupBy(F.col(end).alias("id")).agg(F.count_distinct(other).alias(name))


def module_sample(entities: DataFrame, relations: DataFrame, limit: int) -> DataFrame:
    """Up to `limit` entities: first each module's share of 60 %, modules in order of name, then the rest by degree."""
    rows = entities.select("id", "name", "file").join(degrees(relations), "id", "left").select("id", "name", module_of(F.col("file")).alias("module"), F.coalesce("degree", F.lit(0)).alias("degree"))
    share = rows.agg(F.greatest(F.lit(1), F.floor(F.lit(limit * 60 // 100) / F.count_distinct("module"))).alias("share"))
    order = [F.desc("degree"), "name", "id"]
    # no module gives more than `limit` rows to either part, so the window keeps that many, before and after its shuffle
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy("module").orderBy(*order))).where(F.col("place") <= 2 * limit).join(F.broadcast(share))  # one row
    quota = ranked.where("place <= share").orderBy("module", "place").limit(limit)
    left = quota.agg((F.lit(limit) - F.count("*")).alias("left"))
    # at most `limit` rows can fill up, so that many are ranked
    fill = ranked.where("place > share").orderBy(*order).limit(limit).withColumn("n", F.row_number().over(Window.orderBy(*order))).join(F.broadcast(left)).where(F.col("n") <= F.col("left"))
    return quota.select("id", "module", "degree", F.lit("quota").alias("pass")).unionByName(fill.select("id", "module", "degree", F.lit("fill").alias("pass")))


def link_counts(relations: DataFrame, nodes: DataFrame, known: DataFrame) -> DataFrame:
    """How many relations an export keeps, leaves out for an end that wasn't sampled, or can't resolve."""
    flag = lambda df, name: df.select(F.col("id").alias(name), F.lit(True).alias(f"{name}_in"))
    ends = relations.select("src", "dst")
    for side in ("src", "dst"):
        ends = ends.join(known.select(F.col("id").alias(side), F.lit(True).alias(f"{side}_known")), side, "left").join(nodes.select(F.col("id").alias(side), F.lit(True).alias(f"{side}_node")), side, "left")
    known_both, both = F.col("src_known").isNotNull() & F.col("dst_known").isNotNull(), F.col("src_node").isNotNull() & F.col("dst_node").isNotNull()
    return ends.agg(F.count(F.when(both, 1)).alias("kept"), F.count(F.when(known_both & ~both, 1)).alias("filtered"), F.count(F.when(~known_both, 1)).alias("unresolved"))


def co_change(baskets: DataFrame, least: int = 2, most: int = 20, hub: int | None = 15, min_pairs: int = 1) -> DataFrame:
    """(a, b, pairs, confidence) of baskets (change, item): how often b changes where a does.

    Baskets of other sizes don't count. Items with more than `hub` partners leave before confidences are told. The
    self-join is on the change, whose baskets have at most `most` items, so its output is bounded by most times its rows.
    """
    items = baskets.distinct()
    fit = items.groupBy("change").agg(F.count("*").alias("n")).where(F.col("n").between(least, most)).select("change")
    items = items.join(fit, "change", "left_semi")
    touch = items.groupBy("item").agg(F.count("*").alias("touches"))
    pairs = items.select("change", F.col("item").alias("a")).join(items.select("change", F.col("item").alias("b")), "change").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("pairs"))
    if hub:
        hubs = pairs.groupBy("a").agg(F.count("*").alias("partners")).where(F.col("partners") > hub).select("a")
        pairs = pairs.join(hubs, "a", "left_anti").join(hubs.select(F.col("a").alias("b")), "b", "left_anti")
    return pairs.where(F.col("pairs") >= min_pairs).join(touch, F.col("a") == F.col("item")).select("a", "b", "pairs", (F.col("pairs") / F.col("touches")).alias("confidence"))


def census(old: DataFrame, new: DataFrame, key: str, slip: float = 0.1) -> DataFrame:
    """(key, before, after, verdict) of two histograms (key, n)."""
    both = old.select(key, F.col("n").alias("before")).join(new.select(key, F.col("n").alias("after")), key, "full_outer").select(key, F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
    lost = (F.col("before") - F.col("after")) / F.col("before")
    verdict = F.when(F.col("before") == F.col("after"), "unchanged").when(F.col("before") == 0, "appeared").when(F.col("after") == 0, "vanished").when(F.col("after") > F.col("before"), "grew").when(lost > 0.5, "fell").when(lost > slip, "slipped").otherwise("settled")
    return both.withColumn("verdict", verdict)


def digest(rows: DataFrame) -> DataFrame:
    """(rows, xor, total): order-independent: the XOR and the sum of 60-bit row hashes, folded on the map side."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in rows.columns])
    h = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    return rows.agg(F.count("*").alias("rows"), F.bit_xor(h).alias("xor"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("total"))

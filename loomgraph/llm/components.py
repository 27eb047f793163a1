"""Connected components of links in Spark: hooking parents together and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for each node with a smaller one in its component, the smallest id in it.

    Every edge points from a node to a smaller one. A round links each node and its other parents to its least parent,
    then lets each edge skip to its end's least parent; rounds grow with the logarithm of the longest path. Both
    tables of a round are written to the shared folder, so that its joins can split a node with very many links.
    """
    edges = written(links.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("up")).where("node > up").distinct(), "links")
    while True:
        least = written(edges.groupBy("node").agg(F.min("up").alias("least")), "least")
        hooked = edges.join(least, "node").select(F.explode(F.array(F.struct("node", F.col("least").alias("up")), F.struct(F.col("up").alias("node"), F.col("least").alias("up")))).alias("e")).select("e.*").where("node > up").distinct()
        jump = least.select(F.col("node").alias("up"), F.col("least").alias("higher"))
        after = hooked.join(jump, "up", "left").select("node", F.coalesce("higher", "up").alias("to"), F.col("higher").isNotNull().alias("moved"), "up")
        after = written(after, "edges")
        edges = after.select("node", F.col("to").alias("up")).distinct()
        moved = after.agg(F.count(F.when(F.col("moved"), 1)).alias("moved"), F.count("*").alias("edges"), F.approx_count_distinct("node").alias("nodes")).first()
        if not moved.moved and not edges.groupBy("node").count().where("count > 1").limit(1).count():
            return edges.select("node", F.col("up").alias("root"))

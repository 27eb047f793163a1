"""Reviews whose changes look like the undoing of earlier ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import cut, new_folder

# How many changes before a base are looked through, and how few say nothing.
WINDOW, LEAST = 250, 25
#: Roles of entities that are no contract.
NO_CONTRACT = ("Test", "Generated", "Vendored")


def base_windows(bases: DataFrame, changes: DataFrame, window: int = WINDOW) -> DataFrame:
    """(review, change, distance, place, known): the first `window` changes of bases (review, base) and their ancestry.

    Breadth first, from the base itself, parents of changes (id, parent, merged) in that order; place is the order of the
    walk. Ancestors that nobody has (known is false) end their branch and don't count. Each level has `window` rows for a
    review at most.
    """
    spark, folder = bases.sparkSession, new_folder(bases.sparkSession, "window")
    ups = cut(changes.select("id", F.posexplode(F.array("parent", "merged")).alias("slot", "up")).where("up is not null"))
    ids = cut(changes.select(F.col("id").alias("change"), F.lit(True).alias("known")))
    counted = Window.partitionBy("review").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)

    def placed(step, hop, path):
        """The new changes of a level that still fit, in order."""
        rows = step.withColumn("order", F.row_number().over(Window.partitionBy("review").orderBy("before", "slot"))).where(F.col("order") <= 2 * window)
        rows = rows.join(ids, "change", "left").fillna(False, ["known"]).withColumn("place", F.lit(hop) * 1_000_000 + F.col("order"))
        seen = F.col("scanned") + F.coalesce(F.sum(F.col("known").cast("int")).over(counted), F.lit(0))
        rows = rows.withColumn("seen", seen).where(F.col("seen") < window)
        return cut(rows.select("review", "change", F.lit(hop).alias("distance"), F.col("place").cast("long").alias("place"), "known", (F.col("seen") + F.col("known").cast("int")).cast("long").alias("seen")), path)

    start = bases.select("review", F.col("base").alias("change"), F.lit(0).cast("long").alias("before"), F.lit(0).alias("slot"), F.lit(0).cast("long").alias("scanned"))
    level, hop = placed(start, 0, f"{folder}/0"), 0
    paths = [f"{folder}/0"]
    while True:
        hop += 1
        held = spark.read.schema(level.schema).parquet(*paths)
        scanned = held.groupBy("review").agg(F.max("seen").alias("scanned")).where(F.col("scanned") < window)
        step = level.where("known").join(ups, F.col("change") == F.col("id")).select("review", F.col("up").alias("change"), F.col("place").alias("before"), "slot")
        step = step.groupBy("review", "change").agg(F.min(F.struct("before", "slot")).alias("first")).select("review", "change", "first.*")
        step = step.join(held.select("review", "change"), ["review", "change"], "left_anti").join(scanned, "review")
        level = placed(step, hop, f"{folder}/{hop}")
        if level.isEmpty():
            return spark.read.schema(level.schema).parquet(*paths).drop("seen")
        paths.append(f"{folder}/{hop}")


def evidence_gaps(windows: DataFrame, window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """(review, gap, n, first, distance): incomplete_ancestry, n ancestors that nobody has, the first of them and how far it is; shallow, n changes looked through."""
    lost = windows.where("not known").groupBy("review").agg(F.count("*").alias("n"), F.min_by(F.struct("change", "distance"), "place").alias("f"))
    lost = lost.select("review", F.lit("incomplete_ancestry").alias("gap"), "n", F.col("f.change").alias("first"), F.col("f.distance").alias("distance"))
    few = windows.groupBy("review").agg(F.count(F.when(F.col("known"), 1)).alias("n")).where(F.col("n") < least)
    return lost.unionByName(few.select("review", F.lit("shallow").alias("gap"), "n", F.lit(None).cast("long").alias("first"), F.lit(None).cast("int").alias("distance")))


def revert_findings(windows: DataFrame, deltas: DataFrame, ranges: DataFrame, entities: DataFrame) -> DataFrame:
    """(review, entity, shape, distance, undone, gates) of reviews whose changes are ranges (review, change, n; n: their order).

    deltas (change, entity, op, old, new): hashes of bodies before and after. entities (id, kind, name, visibility, role).

    restored_body: the range changes a body to what it was before a change of the window, the nearest one; gates if two
    entities of the review undo the same change and it is a public function or method. reintroduced: an added entity has
    the last body of one that the window removed; gates if it is public. same_name: its kind and name only. recent_removal:
    the window added it. Tests and generated code never gate. Only the window's changes are evidence.
    """
    about = entities.select(F.col("id").alias("entity"), "kind", "name", ((F.col("visibility") == "Public") & ~F.coalesce(F.col("role"), F.lit("")).isin(*NO_CONTRACT)).alias("public"))
    past = cut(windows.where("known").join(deltas, "change").select("review", "change", "distance", "place", "entity", "op", "old", "new"))
    head = cut(ranges.join(deltas, "change").select("review", "n", "entity", "op", "old", "new"))

    changed = head.where("op = 'modified'").groupBy("review", "entity").agg(F.min_by(F.struct("old"), "n").alias("o"), F.max_by(F.struct("new"), "n").alias("w"))
    changed = changed.select("review", "entity", F.col("o.old").alias("old"), F.col("w.new").alias("new")).where("old <> new")
    bodies = past.where("op = 'modified'").select("review", "entity", F.col("old").alias("new"), "change", "distance", "place")
    restored = changed.join(bodies, ["review", "entity", "new"]).groupBy("review", "entity").agg(F.min_by(F.struct("change", "distance"), "place").alias("u")).select("review", "entity", F.col("u.change").alias("undone"), F.col("u.distance").alias("distance"))
    together = restored.groupBy("review", "undone").agg((F.count("*") > 1).alias("coherent"))
    restored = restored.join(together, ["review", "undone"]).join(about, "entity")
    restored = restored.select("review", "entity", F.lit("restored_body").alias("shape"), "distance", "undone", (F.col("coherent") & F.col("public") & F.col("kind").isin("Function", "Method")).alias("gates"))

    last = past.where("op <> 'removed'").groupBy("review", "entity").agg(F.min_by("new", "place").alias("body"))
    gone = past.where("op = 'removed'").join(last, ["review", "entity"]).join(about, "entity")
    added = head.where("op = 'added'").join(about, "entity").groupBy("review", "kind", "name").agg(F.min_by(F.struct("entity", "new", "public"), "n").alias("a")).select("review", "kind", "name", "a.*")
    by_body = gone.groupBy("review", F.col("body").alias("new")).agg(F.min_by("distance", "place").alias("near"))
    by_name = gone.groupBy("review", "kind", "name").agg(F.min_by("distance", "place").alias("named"))
    again = added.join(by_body, ["review", "new"], "left").join(by_name, ["review", "kind", "name"], "left").where("near is not null or named is not null")
    whole = F.col("near").isNotNull()
    again = again.select("review", "entity", F.when(whole, "reintroduced").otherwise("same_name").alias("shape"), F.coalesce("near", "named").alias("distance"), F.lit(None).cast("long").alias("undone"), (whole & F.col("public")).alias("gates"))

    recent = past.where("op = 'added'").groupBy("review", "entity").agg(F.min_by("distance", "place").alias("distance"))
    recent = head.where("op = 'removed'").select("review", "entity").distinct().join(recent, ["review", "entity"])
    recent = recent.select("review", "entity", F.lit("recent_removal").alias("shape"), "distance", F.lit(None).cast("long").alias("undone"), F.lit(False).alias("gates"))
    return restored.unionByName(again).unionByName(recent)

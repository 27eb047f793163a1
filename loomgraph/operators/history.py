"""Histories: folding logs of changes, states and intervals, diffs, deltas and merges."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import TASK_ROWS, cut, new_folder


def state_at(log: DataFrame, ref: int | None = None) -> DataFrame:
    """The last op of each entity up to an ordinal, without those that it removed."""
    if ref is not None:
        log = log.where(F.col("ord") <= ref)
    last = log.groupBy("entity").agg(F.max_by(F.struct("ord", "op", "value", "note"), "ord").alias("r"))
    return last.where("r.op <> 'removed'").select("entity", "r.ord", "r.value", "r.note")


def _ways(rows: pd.DataFrame) -> pd.DataFrame:
    """rows (block, id, to) of one block, each with `exit`, the first node outside that it leads to, and the steps there."""
    rows = rows.sort_values("id", ignore_index=True)
    ids, to = rows["id"].to_numpy(), rows["to"].to_numpy()
    at = np.minimum(np.searchsorted(ids, to), len(ids) - 1)
    inside = ids[at] == to
    last, steps = np.where(inside, at, np.arange(len(ids))), inside.astype("int64")
    for _ in range(len(ids).bit_length()):
        steps, last = steps + steps[last], last[last]
    if inside[last].any():
        raise ValueError("a change is among its own first parents")
    return rows.assign(exit=to[last], steps=steps + 1)


def _between(rows: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
    """(change, back): what starts (block, id, back) pass within their block, themselves aside."""
    to = dict(zip(rows["id"], rows["to"], strict=True)) if len(starts) else {}
    out = []
    for change, back in zip(starts["id"], starts["back"], strict=True):
        change, back = to.get(change), back + 1
        while change in to:
            out.append((change, back))
            change, back = to[change], back + 1
    return pd.DataFrame(out, columns=["change", "back"])


def first_parents(changes: DataFrame, head: DataFrame, block: int = TASK_ROWS) -> DataFrame:
    """(change, back): head (id) and its first parents by changes (id, parent), with the steps back to each.

    Changes lie in blocks by id. Each block tells where its changes leave it, so that the chain is first found from block
    to block, then filled in within each. As parents mostly are near, few ways lead from block to block and a chain moves
    each change a fixed number of times; where parents are anywhere, all lead to other blocks and only the doubling is left.
    """
    kind = changes.schema["id"].dataType.simpleString()
    rows = changes.where("parent is not null").select("id", F.col("parent").cast(kind).alias("to"))
    n = max(1, -(-rows.count() // block))
    rows = rows.repartitionByRange(n, "id").select(F.spark_partition_id().alias("block"), "id", "to")
    ways = cut(rows.mapInPandas(lambda parts: (_ways(p) for p in [pd.concat([x for x in parts if len(x)] or [pd.DataFrame()])] if len(p)), f"block int, id {kind}, to {kind}, exit {kind}, steps long"))
    ends = cut(ways.select(F.col("exit").alias("id")).distinct().unionByName(head.select("id")).distinct())
    chain = _doubled(ways.join(ends, "id", "left_semi").select("id", F.col("exit").alias("to"), F.col("steps").alias("long")), head)
    starts = cut(ways.select("block", "id").join(chain.select(F.col("change").alias("id"), "back"), "id"))
    # a block has about as many rows as a task takes
    inner = ways.select("block", "id", "to").groupBy("block").cogroup(starts.groupBy("block")).applyInPandas(_between, f"change {kind}, back long")
    return cut(chain.unionByName(inner))


def _doubled(ways: DataFrame, head: DataFrame) -> DataFrame:
    """(change, back): head (id) and all that ways (id, to, long: how many steps) lead to from there.

    A round takes up to three jumps from each change so far, and makes the next round's jumps four times as long, so a
    chain of n takes log4 n rounds of joins, each written to the shared folder.
    """
    spark, folder = head.sparkSession, new_folder(head.sparkSession, "chain")

    def jumps(rows, start, n):
        """rows with to1 .. ton and long1 .. longn: where one to n jumps from a column lead, null beyond the chain's beginning."""
        for i in range(1, n + 1):
            before = start if i == 1 else f"to{i - 1}"
            rows = rows.join(jump.select(F.col("id").alias(before), F.col("to").alias(f"to{i}"), F.col("long").alias(f"long{i}")), before, "left")
        return rows

    far = lambda n: reduce(lambda a, b: a + b, [F.col(f"long{i}") for i in range(1, n + 1)])
    jump = cut(ways)
    chain, length = cut(head.select(F.col("id").alias("change"), F.lit(0).cast("long").alias("back")), f"{folder}/0"), 1
    paths = [f"{folder}/0"]
    while True:
        steps = F.array(*[F.struct(F.col(f"to{i}").alias("change"), (F.col("back") + far(i)).alias("back")) for i in (1, 2, 3)])
        more = cut(jumps(chain, "change", 3).select(F.explode(steps).alias("s")).select("s.*").where("change is not null"), f"{folder}/{length}")
        if more.isEmpty():
            return chain
        paths.append(f"{folder}/{length}")
        chain, length = spark.read.schema(chain.schema).parquet(*paths), 4 * length
        jump = cut(jumps(jump.select("id"), "id", 4).where("to4 is not null").select("id", F.col("to4").alias("to"), far(4).alias("long")))


def next_removals(ends: DataFrame, gone: DataFrame, span: int) -> DataFrame:
    """ends (node, at, ...) with next (at, change): the first removal of gone (node, at, change) of their node at their time or later.

    Time is cut into spans, so that no task holds more of a very common node than one span of it; what comes in later
    spans is known from the first removal of each.
    """
    cell = F.floor(F.col("at") / span).alias("cell")
    gone = gone.select("node", "at", F.struct("at", "change").alias("next"), cell)
    ends = ends.withColumn("cell", cell)
    columns = [c for c in ends.columns if c not in ("node", "at", "cell")]
    row = F.struct(*columns).alias("end")
    here = Window.partitionBy("node", "cell").orderBy(F.desc("at"), F.col("end").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = ends.select("node", "at", "cell", row).withColumn("next", F.lit(None).cast(gone.schema["next"].dataType)).unionByName(gone.withColumn("end", F.lit(None).cast(ends.select(row).schema["end"].dataType)))
    own = both.withColumn("own", F.last("next", True).over(here)).where("end is not null")
    first = both.groupBy("node", "cell").agg(F.min("next").alias("first"))
    after = first.withColumn("after", F.last("first", True).over(Window.partitionBy("node").orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1))).where("after is not null").select("node", "cell", "after")
    found = own.join(after, ["node", "cell"], "left")
    return found.select("node", "at", "end.*", F.coalesce("own", "after").alias("next"))


def resolve_at(chain: DataFrame, entity_log: DataFrame, relation_log: DataFrame, span: int = 4096) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities (id, change), relations (id, src, dst, change) and tombstones (part, id, change) at the head of a chain.

    entity_log (change, id, op) and relation_log (change, id, src, dst, op) count only along the chain; a change has one
    op for each id. Removing an entity prunes the relations that it has then, and adding it again doesn't bring them
    back; a change that removes an entity prunes what it adds to it, too. Relations need both ends to stay.
    """
    on = chain.select("change", (-F.col("back")).alias("at"))
    e, r = cut(entity_log.join(on, "change")), relation_log.join(on, "change")
    last = cut(e.groupBy("id").agg(F.max_by(F.struct("op", "change"), "at").alias("l")).select("id", "l.*"))
    alive = last.where("op <> 'removed'").select("id", "change")
    now = cut(r.groupBy("id").agg(F.max_by(F.struct("op", "change", "src", "dst", "at"), "at").alias("l")).select("id", "l.*"))
    ends = now.where("op <> 'removed'").select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("node"), "at", F.col("id").alias("relation"))
    gone = e.where("op = 'removed'").select(F.col("id").alias("node"), "at", "change")
    pruned = next_removals(ends, gone, span).where("next is not null")
    pruned = cut(pruned.groupBy(F.col("relation").alias("id")).agg(F.min("next").alias("n")).select("id", F.col("n.change").alias("change")))
    kept = now.where("op <> 'removed'").join(pruned, "id", "left_anti")
    for end in ("src", "dst"):
        kept = kept.join(alive.select(F.col("id").alias(end)), end, "left_semi")
    part = lambda df, name: df.select(F.lit(name).alias("part"), "id", "change")
    dead = part(last.where("op = 'removed'"), "entity").unionByName(part(now.where("op = 'removed'"), "relation")).unionByName(part(pruned, "relation"))
    return alive, kept.select("id", "src", "dst", "change"), dead


def revisions(log: DataFrame) -> DataFrame:
    """(entity, introduced, ended, value): each op but a removal holds until the entity's next one."""
    after = F.lead("ord").over(Window.partitionBy("entity").orderBy("ord"))
    return log.withColumn("ended", after).where("op <> 'removed'").select("entity", F.col("ord").alias("introduced"), "ended", "value")


def active_at(revisions: DataFrame, ref: int) -> DataFrame:
    """Revisions of which [introduced, ended) holds an ordinal."""
    return revisions.where((F.col("introduced") <= ref) & (F.col("ended").isNull() | (F.col("ended") > ref)))


def blame(log: DataFrame, ref: int) -> DataFrame:
    """Revisions up to an ordinal that changed the value; equal neighbours are one."""
    w = Window.partitionBy("entity").orderBy("ord")
    rows = log.where((F.col("ord") <= ref) & (F.col("op") != "removed")).withColumn("before", F.lag("value").over(w)).withColumn("n", F.row_number().over(w))
    return rows.where((F.col("n") == 1) | ~F.col("before").eqNullSafe(F.col("value"))).select("entity", "ord", "value", "note")


def net_effect(log: DataFrame) -> DataFrame:
    """(entity, op, old, new): what a run of ops amounts to.

    Added then removed is nothing; removed then added is added; modified after added stays added; a removal keeps the
    value that stood before it.
    """
    w = Window.partitionBy("entity").orderBy("ord")
    rows = log.withColumn("old", F.lag("value").over(w)).withColumn("old_op", F.lag("op").over(w))
    ops = rows.groupBy("entity").agg(
        F.min_by("op", "ord").alias("first_op"), F.max_by("op", "ord").alias("last_op"), F.max_by("value", "ord").alias("new"), F.max_by(F.struct("old"), "ord").alias("old"),
        F.max(F.when(F.col("op") == "removed", F.col("ord"))).alias("removed"), F.min_by(F.struct("ord"), "ord").alias("start"), F.max(F.when(F.col("op") == "added", F.col("ord"))).alias("added"),
    )
    born = (F.col("first_op") == "added") & F.col("removed").isNull() | (F.col("added") > F.col("removed"))
    op = F.when((F.col("last_op") == "removed") & (F.col("first_op") == "added"), None).when(F.col("last_op") == "removed", "removed").when(F.coalesce(born, F.lit(False)), "added").otherwise("modified")
    return ops.withColumn("net", op).where("net is not null").select("entity", F.col("net").alias("op"), F.when(F.col("net") != "removed", F.col("new")).alias("new"), F.when(F.col("net") == "removed", F.col("old.old")).alias("old"))


def diff(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, change): added, removed or modified rows; modified if any of the columns differs."""
    a = old.select(key, F.struct(*columns).alias("a"))
    b = new.select(key, F.struct(*columns).alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "modified")
    return a.join(b, key, "full_outer").withColumn("change", change).where("change is not null")


def field_changes(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, field, old, new): the fields that differ in rows of both."""
    both = old.select(key, *[F.col(c).cast("string").alias(f"a_{c}") for c in columns]).join(new.select(key, *[F.col(c).cast("string").alias(f"b_{c}") for c in columns]), key)
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"a_{c}").alias("old"), F.col(f"b_{c}").alias("new")) for c in columns])
    return both.select(key, F.explode(F.filter(fields, lambda f: ~f["old"].eqNullSafe(f["new"]))).alias("f")).select(key, "f.field", "f.old", "f.new")


def bag_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Distinct rows of one side only, with the side."""
    same = list(old.columns)
    cond = lambda a, b: reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in same])
    gone = old.alias("x").join(new.alias("y"), cond(old, new), "left_anti").distinct().withColumn("side", F.lit("removed"))
    come = new.alias("x").join(old.alias("y"), cond(new, old), "left_anti").distinct().withColumn("side", F.lit("added"))
    return gone.unionByName(come)


def apply_bag(base: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """All rows equal to a removed one leave, then the added ones come."""
    cond = reduce(lambda x, y: x & y, [base[c].eqNullSafe(removed[c]) for c in base.columns])
    return base.join(removed, cond, "left_anti").unionByName(added)


def apply_deltas(base: DataFrame, deltas: DataFrame, key: str) -> DataFrame:
    """base with deltas (key, ..., op, ord) applied in order: the last op of a key counts."""
    columns = base.columns
    last = deltas.groupBy(key).agg(F.max_by(F.struct("op", *[F.col(c) for c in columns if c != key]), "ord").alias("d"))
    kept = base.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.where("d.op <> 'removed'").select(*[F.col(key) if c == key else F.col(f"d.{c}").alias(c) for c in columns]))


def inverse(deltas: DataFrame) -> DataFrame:
    """Deltas (key, op, old, new) that undo others."""
    op = F.when(F.col("op") == "added", "removed").when(F.col("op") == "removed", "added").otherwise(F.col("op"))
    return deltas.select(*[c for c in deltas.columns if c not in ("op", "old", "new")], op.alias("op"), F.col("new").alias("old"), F.col("old").alias("new"))


def semver(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, impact, reason) of an API between two states (id, visibility, signature, body)."""
    a = old.select("id", F.col("visibility").alias("av"), F.col("signature").alias("asig"), F.col("body").alias("ab"))
    b = new.select("id", F.col("visibility").alias("bv"), F.col("signature").alias("bsig"), F.col("body").alias("bb"))
    public_a, public_b = F.coalesce(F.col("av") == "Public", F.lit(False)), F.coalesce(F.col("bv") == "Public", F.lit(False))
    reason = (
        F.when(public_a & F.col("bv").isNull(), "removed").when(public_a & ~public_b, "unpublished").when(F.col("av").isNull() & public_b, "added").when(~public_a & public_b, "published")
        .when(public_a & public_b & ~F.col("asig").eqNullSafe(F.col("bsig")), "signature").when(public_a & public_b & ~F.col("ab").eqNullSafe(F.col("bb")), "behaviour")
    )
    impact = F.when(F.col("reason").isin("removed", "unpublished", "signature"), "major").when(F.col("reason").isin("added", "published"), "minor").otherwise("patch")
    return a.join(b, "id", "full_outer").withColumn("reason", reason).where("reason is not null").select("id", impact.alias("impact"), "reason")


def merge3(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(id, outcome) of tables (id, value): what a three-way merge takes, or the kind of conflict."""
    return composed(base, ours, theirs).select("id", "outcome")


def composed(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(id, outcome, value, survives): also the merged value, null in a conflict, and whether the id is still there; in a conflict it is."""
    o, a, b = (t.select("id", F.struct("value").alias(n)) for t, n in ((base, "o"), (ours, "a"), (theirs, "b")))
    has = lambda c: F.col(c).isNotNull()
    same = lambda x, y: F.col(x).eqNullSafe(F.col(y))
    outcome = (
        F.when(same("a", "b"), F.when(same("a", "o"), "unchanged").otherwise("same_change"))
        .when(same("a", "o"), "take_theirs").when(same("b", "o"), "take_ours")
        .when(~has("o"), "added_both_sides").when(~has("a"), "removed_ours_changed_theirs").when(~has("b"), "changed_ours_removed_theirs").otherwise("changed_both_sides")
    )
    taken = F.when(F.col("outcome") == "take_theirs", F.col("b")).when(F.col("outcome").isin("unchanged", "same_change", "take_ours"), F.col("a"))
    rows = o.join(a, "id", "full_outer").join(b, "id", "full_outer").withColumn("outcome", outcome).withColumn("taken", taken)
    return rows.select("id", "outcome", F.col("taken.value").alias("value"), (F.col("taken").isNotNull() | F.col("outcome").isin(*CONFLICTS)).alias("survives"))


CONFLICTS = ("added_both_sides", "removed_ours_changed_theirs", "changed_ours_removed_theirs", "changed_both_sides")


def path_collisions(artifacts: DataFrame) -> DataFrame:
    """(path, id): distinct artifacts (id, path) that claim one path."""
    n = artifacts.where("path is not null").groupBy("path").agg(F.count_distinct("id").alias("n")).where("n > 1").select("path")
    return artifacts.join(n, "path", "left_semi").select("path", "id").distinct()


def dangling(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, endpoint): ends of relations (id, src, dst) that aren't among nodes (id)."""
    ends = relations.select("id", F.explode(F.array_distinct(F.array("src", "dst"))).alias("endpoint"))
    return ends.join(nodes.select(F.col("id").alias("endpoint")), "endpoint", "left_anti").select("id", "endpoint")


def severed(edges: DataFrame, removed: DataFrame, ends: tuple[str, ...] = ("src", "dst")) -> DataFrame:
    """edges (id, src, dst, ended) that ended with the removal (node, ended) of one of their ends, of those named."""
    found = [edges.join(removed.select(F.col("node").alias(end), "ended"), [end, "ended"], "left_semi").select(*edges.columns) for end in ends]
    return reduce(DataFrame.unionByName, found).distinct()


def reversions(log: DataFrame, window: int = 250) -> DataFrame:
    """(entity, ord, undone, distance): a change back to a value that an earlier revision of the last `window` had, the nearest one."""
    w = Window.partitionBy("entity").orderBy("ord")
    rows = log.where("op <> 'removed'").withColumn("n", F.row_number().over(w)).withColumn("before", F.lag("value").over(w)).withColumn("seen", F.max("n").over(Window.partitionBy("entity", "value").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)))
    hit = rows.where((F.col("before") != F.col("value")) & F.col("seen").isNotNull() & (F.col("n") - F.col("seen") <= window))
    return hit.select("entity", "ord", (F.col("seen") + 1).cast("int").alias("undone"), (F.col("n") - F.col("seen")).cast("int").alias("distance"))


def change_shape(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, shape, guards, removed) of bodies as statements (id, n, hash, guard): what was added to or taken from each.

    Only early-exit guards added: added_narrowing_guard. Only statements gone: removed_guard_or_widened. The same
    statements in the same order: equivalent. Anything else: other.
    """
    sides = old.withColumn("side", F.lit(-1)).unionByName(new.withColumn("side", F.lit(1)))
    moved = sides.groupBy("id", "hash", "guard").agg(F.sum("side").alias("d")).groupBy("id").agg(
        F.sum(F.greatest("d", F.lit(0))).alias("added"), F.sum(F.when(F.col("guard"), F.greatest("d", F.lit(0))).otherwise(0)).alias("guards"), F.sum(F.greatest(-F.col("d"), F.lit(0))).alias("removed")
    )
    order = sides.groupBy("id", "n").agg(F.sum(F.col("side") * F.xxhash64("hash", "guard").cast("decimal(38,0)")).alias("d")).groupBy("id").agg(F.max(F.col("d") != 0).alias("reordered"))
    shape = F.when(~F.col("reordered"), "equivalent").when((F.col("removed") == 0) & (F.col("added") > 0) & (F.col("added") == F.col("guards")), "added_narrowing_guard").when((F.col("added") == 0) & (F.col("removed") > 0), "removed_guard_or_widened").otherwise("other")
    return moved.join(order, "id").select("id", shape.alias("shape"), F.col("guards").cast("long").alias("guards"), F.col("removed").cast("long").alias("removed"))


def semantic_diff(old: DataFrame, new: DataFrame, key: str, semantic: list[str], other: list[str], files: list[str] | None = None, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Changes (key, file, change) and, in one row, how many edits of other columns alone were suppressed.

    Rows have a file; with files or ids (key) only those in a file on either side, or with an id, are compared.
    """
    side = lambda df, n: df.select(key, F.struct(*semantic).alias(f"{n}s"), F.struct(*other).alias(f"{n}o"), F.col("file").alias(f"{n}f"))
    rows = side(old, "a").join(side(new, "b"), key, "full_outer")
    rows = rows.where(F.coalesce(F.col("af").isin(files), F.lit(False)) | F.coalesce(F.col("bf").isin(files), F.lit(False))) if files is not None else rows
    rows = rows.join(ids.select(key).distinct(), key, "left_semi") if ids is not None else rows
    change = (
        F.when(F.col("as").isNull(), "added").when(F.col("bs").isNull(), "removed").when(~F.col("as").eqNullSafe(F.col("bs")), "modified").when(~F.col("ao").eqNullSafe(F.col("bo")), "suppressed")
    )
    rows = rows.withColumn("change", change)
    return rows.where("change <> 'suppressed'").select(key, F.coalesce("bf", "af").alias("file"), "change"), rows.agg(F.count(F.when(F.col("change") == "suppressed", 1)).alias("suppressed"))

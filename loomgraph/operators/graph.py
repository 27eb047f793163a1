"""Traversals as frontier joins: every level is one equi-join of the frontier with the edges, for all roots at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import bucketed, cut, dealt, new_folder, rows_read
from .filters import IMPACT_KINDS, impact_relations


def edges_of(relations: DataFrame, direction: str = "out", kinds=None) -> DataFrame:
    """(a, b) steps: out follows src to dst, in the reverse, both either."""
    if kinds:
        relations = relations.where(F.col("kind").isin(*kinds))
    out = relations.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    back = relations.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction].transform(dealt, "a", "b").distinct()


def steps_of(relations: DataFrame, direction: str = "out", kinds=None) -> DataFrame:
    """The steps of edges_of for reach, to be given as stored: written once for both directions, not dealt out to be made distinct, as reach meets a node once anyway."""
    if kinds:
        relations = relations.where(F.col("kind").isin(*kinds))
    rows = cut(relations.select("src", "dst"))
    out = rows.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    back = rows.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


def reach(roots: DataFrame, edges: DataFrame, depth: int | None = None, most: int | None = None, stored: bool = False) -> DataFrame:
    """(root, node, hop): what roots (root, node) reach over edges (a, b) in `depth` steps, by the least number of them.

    A root that has reached more than `most` nodes goes no further.

    The edges and each level are written to the shared folder, so that nothing is computed twice and lost executors cost
    only their own tasks. A level reads only the edges of its frontier, and leaves out by one anti-join what the files of
    all earlier levels hold. Without a depth it ends when a level finds nothing new. Edges that are `stored` already, some
    perhaps several times, aren't written again.
    """
    spark = roots.sparkSession
    edges = cut(edges) if not stored and (depth is None or depth > 1) else edges
    folder, hop = new_folder(spark, "reach"), 0
    frontier = cut(roots.select("root", "node", F.lit(0).alias("hop")).distinct(), f"{folder}/0")
    paths = [f"{folder}/0"]
    while depth is None or hop < depth:
        hop += 1
        seen = spark.read.schema(frontier.schema).parquet(*paths).select("root", "node")
        step = frontier.select("root", "node").join(edges, F.col("node") == F.col("a")).select("root", F.col("b").alias("node")).distinct()
        frontier = cut(step.join(seen, ["root", "node"], "left_anti").select("root", "node", F.lit(hop).alias("hop")), f"{folder}/{hop}")
        if frontier.isEmpty():
            break
        paths.append(f"{folder}/{hop}")
        if most is not None:
            full = spark.read.schema(frontier.schema).parquet(*paths).groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > most).select("root")
            frontier = frontier.join(full, "root", "left_anti")
    return spark.read.schema(frontier.schema).parquet(*paths)


def rooted(nodes: DataFrame, column: str = "id") -> DataFrame:
    return nodes.select(F.col(column).alias("root"), F.col(column).alias("node"))


def neighbourhood(start: DataFrame, entities: DataFrame, relations: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """Entities that known starts reach along outgoing relations, and every relation out of a node that was expanded.

    A node beyond the entities is expanded, not returned; relations out of nodes at the last level aren't reported.
    """
    known = start.join(entities, "id", "left_semi")
    got = reach(rooted(known), steps_of(relations), depth, stored=True)
    nodes = got.join(entities.select(F.col("id").alias("node")), "node", "left_semi")
    passed = got.where(F.col("hop") < depth).select("root", F.col("node").alias("src"))
    return nodes, relations.join(passed, "src")


def expand(seeds: DataFrame, entities: DataFrame, relations: DataFrame, depth: int, kinds=None) -> tuple[DataFrame, DataFrame]:
    """Both directions from several seeds at once; relations once each."""
    known = seeds.join(entities, "id", "left_semi").select(F.lit("all").alias("root"), F.col("id").alias("node"))
    got = reach(known, steps_of(relations, "both", kinds), depth, stored=True)
    nodes = got.join(entities.select(F.col("id").alias("node")), "node", "left_semi")
    passed = got.where(F.col("hop") < depth).select("node")
    some = relations.where(F.col("kind").isin(*kinds)) if kinds else relations
    touched = some.join(passed, some.src == passed.node, "left_semi").unionByName(some.join(passed, some.dst == passed.node, "left_semi"))
    return nodes, touched.distinct()


# The kinds of nodes that a relation may join.
NODE_KINDS = ("entity", "artifact", "test", "contract", "work", "annotation", "external")


def typed(kind, key):
    """A node of one of the kinds, as one value."""
    return F.concat_ws(":", kind, key.cast("string"))


def traverse(starts: DataFrame, relations: DataFrame, nodes: DataFrame, depth: int, kinds=None) -> tuple[DataFrame, DataFrame]:
    """Nodes (root, kind, id, hop, known) and relations (root, relation) around starts (kind, id), in both directions.

    relations (id, kind, src_kind, src, dst_kind, dst) join nodes of NODE_KINDS; external references are nodes like others, so
    what a graph points at beyond itself stays in the result. nodes (kind, id): those that are recorded; others that
    a relation names are reported with known false, and gone through all the same. A relation counts once it touches a node
    that was expanded.
    """
    some = relations.where(F.col("kind").isin(*kinds)) if kinds else relations
    steps = cut(some.select("id", typed(F.col("src_kind"), F.col("src")).alias("a"), typed(F.col("dst_kind"), F.col("dst")).alias("b")))  # once for both directions
    steps = steps.unionByName(steps.select("id", F.col("b").alias("a"), F.col("a").alias("b")))
    root = typed(F.col("kind"), F.col("id"))
    got = reach(starts.select(root.alias("root"), root.alias("node")), steps.select("a", "b"), depth, stored=True)
    passed = cut(got.where(F.col("hop") < depth).select("root", F.col("node").alias("a")))  # mostly far fewer than those at the last level
    touched = passed.join(steps.select("a", F.col("id").alias("relation")), "a").select("root", "relation").distinct()
    recorded = nodes.select(typed(F.col("kind"), F.col("id")).alias("node")).join(got.select("node"), "node", "left_semi").distinct().withColumn("known", F.lit(True))
    out = got.join(recorded, "node", "left").select("root", F.substring_index("node", ":", 1).alias("kind"), F.expr("substr(node, instr(node, ':') + 1)").alias("id"), "hop", F.coalesce("known", F.lit(False)).alias("known"))
    return out, touched


def downstream(start: DataFrame, entities: DataFrame, relations: DataFrame, depth: int) -> DataFrame:
    """(root, node, hop): entities that depend on a start along incoming relations; the start itself isn't among them."""
    got = reach(rooted(start), steps_of(relations, "in"), depth, stored=True)
    return got.where("hop > 0").join(entities.select(F.col("id").alias("node")), "node", "left_semi")


# Points of an impact by what it makes of its source, and by the kind of relation.
BUCKET_POINTS = {"contract_consumer": 500, "runtime_caller": 450, "type_dependent": 400, "dependent": 350, "test": 250, "derived": 100}
RELATION_POINTS = ((120, ("ConsumesContract",)), (110, ("Calls", "Spawns")), (105, ("Extends", "Implements", "Overrides")), (90, ("Instantiates", "References", "UsesType")), (80, ("SubscribesTo", "SendsMessage")), (70, ("Imports", "Includes", "DependsOn")), (50, ("Tests", "Covers")), (40, ("UsesMacro", "DerivedFrom")))


def bucket(role, kind):
    """What an inbound relation makes of its source."""
    return (
        F.when(role.isin("Generated", "Vendored") | (kind == "DerivedFrom"), "derived")
        .when((role == "Test") | kind.isin("Tests", "Covers"), "test")
        .when(kind == "ConsumesContract", "contract_consumer")
        .when(kind.isin("Calls", "Spawns", "Instantiates", "SendsMessage"), "runtime_caller")
        .when(kind.isin("Extends", "Implements", "Overrides", "UsesType"), "type_dependent")
        .otherwise("dependent")
    )


def ranked_impact(start: DataFrame, entities: DataFrame, relations: DataFrame, depth: int = 8) -> DataFrame:
    """(root, node, hop, bucket, kind, score): each dependent once, by its best relation into the levels before it.

    score = bucket + relation kind + max(0, 240 - 60 (hop - 1)) + confidence in per cent + 25 with evidence.
    """
    inbound = impact_relations(relations)
    got = reach(rooted(start), inbound.select(F.col("dst").alias("a"), F.col("src").alias("b")).distinct(), depth)
    at = got.where(F.col("hop") < depth).select("root", F.col("node").alias("dst"), (F.col("hop") + 1).alias("hop"))
    step = inbound.join(at, "dst").join(entities.select(F.col("id").alias("src"), "role"), "src").where("src <> root")
    points = F.when(F.lit(False), 0)
    for n, kinds in RELATION_POINTS:
        points = points.when(F.col("kind").isin(*kinds), n)
    step = step.withColumn("bucket", bucket(F.col("role"), F.col("kind")))
    by_bucket = F.when(F.lit(False), 0)
    for name, n in BUCKET_POINTS.items():
        by_bucket = by_bucket.when(F.col("bucket") == name, n)
    score = by_bucket + points.otherwise(0) + F.greatest(F.lit(0), 240 - 60 * (F.col("hop") - 1)) + F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "confidence")) * 100).cast("int") + F.when(F.col("evidence") > 1, 25).otherwise(0)
    best = Window.partitionBy("root", "src").orderBy(F.desc("score"), "hop", "kind", "id")
    ranked = step.withColumn("score", score.cast("int")).withColumn("n", F.row_number().over(best)).where("n = 1")
    return ranked.select("root", F.col("src").alias("node"), "hop", "bucket", "kind", "score")


def dead_code(candidates: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Candidates without a relation from an entity of another file; two entities without a file share one."""
    return candidates.join(cross_file_targets(entities, relations), "id", "left_anti")


def cross_file_targets(entities: DataFrame, relations: DataFrame, kinds=None) -> DataFrame:
    """Ids with a relation from another file; a source that isn't an entity proves nothing."""
    if kinds:
        relations = relations.where(F.col("kind").isin(*kinds))
    files = entities.select("id", "file")
    pairs = relations.select("src", "dst").join(files.select(F.col("id").alias("src"), F.col("file").alias("src_file")), "src").join(files.select(F.col("id").alias("dst"), F.col("file").alias("dst_file")), "dst")
    return pairs.where(~F.col("src_file").eqNullSafe(F.col("dst_file"))).select(F.col("dst").alias("id")).distinct()


def routes(pairs: DataFrame, relations: DataFrame, depth: int, limit: int = 5, kinds=None) -> DataFrame:
    """pairs (root, goal): shortest routes as `a>b>c` text, the first `limit` in order of that text."""
    edges = edges_of(relations, "out", kinds)
    hops = reach(pairs.select("root", F.col("root").alias("node")).distinct(), edges, depth)
    goal = hops.join(pairs.select("root", F.col("goal").alias("node")), ["root", "node"]).select("root", F.col("node").alias("goal"), F.col("hop").alias("length"))
    # back from the goal, only over nodes one level nearer to the root
    paths = goal.select("root", "goal", "length", F.col("goal").alias("node"), F.col("goal").alias("path"), F.col("length").alias("hop"))
    for _ in range(depth):
        before = paths.where("hop > 0").join(edges, F.col("node") == F.col("b")).join(hops.select(F.col("root").alias("r"), F.col("node").alias("a"), F.col("hop").alias("h")), "a").where("r = root and h = hop - 1")
        paths = paths.where("hop = 0").unionByName(before.select("root", "goal", "length", F.col("a").alias("node"), F.concat_ws(">", "a", "path").alias("path"), (F.col("hop") - 1).alias("hop")))
    n = F.row_number().over(Window.partitionBy("root", "goal").orderBy("path"))
    return paths.withColumn("n", n).where(F.col("n") <= limit).select("root", "goal", F.col("length").alias("hops"), "path")


def trace(start: DataFrame, relations: DataFrame, depth: int = 3, per_step: int = 10, direction: str = "out") -> DataFrame:
    """(root, node, hop, via): a walk that follows the first `per_step` new nodes of each node, by name."""
    edges = edges_of(relations, direction)
    level = cut(rooted(start).withColumn("hop", F.lit(0)).withColumn("via", F.lit(None).cast("string")))
    levels = [level]
    for hop in range(1, min(depth, 8) + 1):
        step = level.join(edges, F.col("node") == F.col("a")).select("root", F.col("a").alias("via"), F.col("b").alias("node"))
        step = step.withColumn("n", F.row_number().over(Window.partitionBy("root", "via").orderBy("node"))).where(F.col("n") <= per_step)
        step = step.groupBy("root", "node").agg(F.min("via").alias("via"))
        for earlier in levels:
            step = step.join(earlier.select("root", "node"), ["root", "node"], "left_anti")
        level = cut(step.select("root", "node", F.lit(hop).alias("hop"), "via"))
        levels.append(level)
    out = levels[0]
    for other in levels[1:]:
        out = out.unionByName(other)
    return out


def ancestry(heads: DataFrame, changes: DataFrame, first_parent: bool = False) -> DataFrame:
    """(root, node, hop): heads (root, node) and all changes before them, over both parents or the first alone."""
    steps = changes.select(F.col("id").alias("a"), F.col("parent").alias("b"))
    if not first_parent:
        steps = steps.unionByName(changes.select(F.col("id").alias("a"), F.col("merged").alias("b")))
    got = reach(heads, steps.where("b is not null"))
    return got


def missing_parents(got: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes that an ancestry reaches and the history lacks; a caller fails if there are any."""
    return got.join(changes.select(F.col("id").alias("node")), "node", "left_anti")


def merge_base(got: DataFrame, changes: DataFrame, left: str, right: str) -> DataFrame:
    """Common ancestors of two roots that no other common ancestor has before it."""
    both = cut(got.where(F.col("root") == left).select("node").intersect(got.where(F.col("root") == right).select("node")))
    steps = changes.select("id", F.col("parent").alias("up")).unionByName(changes.select("id", F.col("merged").alias("up"))).where("up is not null")
    covered = steps.join(both.select(F.col("node").alias("id")), "id", "left_semi").select(F.col("up").alias("node"))
    return both.join(covered, "node", "left_anti")


def ahead_behind(got: DataFrame, left: str, right: str) -> DataFrame:
    a, b = (got.where(F.col("root") == r).select("node") for r in (left, right))
    ahead = a.join(b, "node", "left_anti").agg(F.count("*").alias("ahead"))
    return ahead.join(F.broadcast(b.join(a, "node", "left_anti").agg(F.count("*").alias("behind"))))  # one row each


# Fixed value: how many changes of either side a comparison looks through.
COMPARED = 10_000


def compare(pairs: DataFrame, changes: DataFrame, most: int = COMPARED) -> DataFrame:
    """(pair, ahead, behind, base, bases, refusal) of pairs (pair, base, head) of changes (id, parent, merged).

    ahead: what the head reaches and the base doesn't, behind the reverse; base: the common ancestor that no other common
    one has before it. Refused, without these numbers: history_too_deep if a side reaches more than `most` changes,
    no_common_ancestor, ambiguous_merge_base if there are several (bases of them). A side stops growing once it is too deep.
    """
    steps = cut(changes.select(F.col("id").alias("a"), F.explode(F.array("parent", "merged")).alias("b")).where("b is not null").distinct())
    side = lambda name: pairs.select(F.concat_ws("|", F.lit(name), F.col("pair").cast("string")).alias("root"), F.col(name).alias("node"))
    got = reach(side("base").unionByName(side("head")), steps, most=most).select(F.substring("root", 1, 4).alias("side"), F.substring("root", 6, 1 << 20).alias("pair"), "node")
    both = cut(got.groupBy("pair", "node").agg(F.max(F.col("side") == "base").alias("in_base"), F.max(F.col("side") == "head").alias("in_head")))
    count = lambda *c: F.count(F.when(F.expr(" and ".join(c)), 1))
    n = both.groupBy("pair").agg(count("in_base").alias("n_base"), count("in_head").alias("n_head"), count("in_head", "not in_base").alias("ahead"), count("in_base", "not in_head").alias("behind"), count("in_base", "in_head").alias("common"))
    common = both.where("in_base and in_head").select("pair", "node")
    covered = common.join(steps, F.col("node") == F.col("a")).select("pair", F.col("b").alias("node")).distinct()
    best = common.join(covered, ["pair", "node"], "left_anti").groupBy("pair").agg(F.min("node").alias("one"), F.count("*").alias("bases"))
    rows = pairs.select(F.col("pair").cast("string").alias("pair")).join(n, "pair").join(best, "pair", "left").fillna(0, ["bases"])
    refusal = F.when(F.greatest("n_base", "n_head") > most, "history_too_deep").when(F.col("common") == 0, "no_common_ancestor").when(F.col("bases") > 1, "ambiguous_merge_base")
    known = lambda c: F.when(F.col("refusal").isNull(), F.col(c))
    return rows.withColumn("refusal", refusal).select("pair", known("ahead").alias("ahead"), known("behind").alias("behind"), known("one").alias("base"), F.when(F.coalesce("refusal", F.lit("")) != "history_too_deep", F.col("bases")).alias("bases"), "refusal")


def impact_at(starts: DataFrame, alive: DataFrame, kept: DataFrame, severed: DataFrame, depth: int) -> DataFrame:
    """(root, node, hop): entities alive at a ref that depend on starts (id) there.

    kept (src, dst): relations at the ref; severed (src, dst): those that ended with the removal of dst, over which what
    a removed entity breaks stays in reach. A start may be removed itself.
    """
    inbound = lambda rows: rows.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    gone = inbound(severed).join(alive.select(F.col("id").alias("a")), "a", "left_anti").select("a", "b")
    got = reach(rooted(starts), inbound(kept).unionByName(gone).distinct(), depth)
    return got.where("hop > 0").join(alive.select(F.col("id").alias("node")), "node", "left_semi").select("root", "node", "hop")


def wide(roots: DataFrame, edges: DataFrame, depth: int, most: int) -> DataFrame:
    """(root, n): roots (id) from which more than `most` other nodes are reached over edges (a, b) in `depth` steps; n is at most `most` + 1.

    A node keeps most + 2 of its edges: that is enough to tell, and a root stops growing once it has that many. So what
    is written is bounded by the number of roots, whatever the shape of the graph.
    """
    few = edges.where("a <> b").withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy("b"))).where(F.col("n") <= most + 2).select("a", "b")
    got = reach(rooted(roots), few, depth, most + 1).where("hop > 0")
    return got.groupBy("root").agg(F.least(F.count("*"), F.lit(most + 1)).alias("n")).where(F.col("n") > most)


def spread(sources: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(node, hop): nodes that another node of sources (id) reaches over edges (a, b), with the least number of steps.

    Each node keeps its two nearest sources, itself among them if it is one; more can't matter to any other node. So
    rows are at most two for each node.
    """
    spark, folder = sources.sparkSession, new_folder(sources.sparkSession, "spread")
    edges = cut(edges.distinct())
    level = cut(sources.select(F.col("id").alias("node"), F.col("id").alias("source"), F.lit(0).alias("hop")).distinct(), f"{folder}/0")
    paths = [f"{folder}/0"]
    for hop in range(1, depth + 1):
        held = spark.read.schema(level.schema).parquet(*paths)
        full = held.groupBy("node").agg(F.collect_set("source").alias("sources"))  # two at most
        step = level.join(edges, F.col("node") == F.col("a")).select(F.col("b").alias("node"), "source").distinct().join(full, "node", "left")
        step = step.where(F.col("sources").isNull() | (F.size("sources") < 2) & ~F.array_contains("sources", F.col("source")))
        step = step.withColumn("n", F.row_number().over(Window.partitionBy("node").orderBy("source"))).where(F.col("n") <= 2 - F.coalesce(F.size("sources"), F.lit(0)))
        level = cut(step.select("node", "source", F.lit(hop).alias("hop")), f"{folder}/{hop}")
        if level.isEmpty():
            break
        paths.append(f"{folder}/{hop}")
    return spark.read.schema(level.schema).parquet(*paths).where("node <> source").groupBy("node").agg(F.min("hop").alias("hop"))


#: About how many steps a task gets where they lie in buckets.
STEP_ROWS = 1_000_000


class Dependents:
    """How many nodes each root (id) reaches over edges (a, b) in up to `depth` steps, and from how many roots each node is reached.

    Edges lie in buckets by where they begin, so only what meets them is shuffled. Most nodes are ends, which nothing goes
    on from. A root whose edges all lead to ends reaches just these: its edges are counted as they lie. Only the others,
    upper roots, are followed, and over edges between nodes that go on; their pairs (root, node, hop) are stored, those
    with ends in one step after the rest.
    """

    def __init__(self, edges: DataFrame, roots: DataFrame, depth: int):
        edges = edges.where("a is not null and not (a <=> b)")
        n = rows_read(edges)
        edges = dealt(edges, "b", rows=n, each=STEP_ROWS).distinct()
        goes_on = dealt(edges.select(F.col("a").alias("b")).distinct(), "b", rows=n, each=STEP_ROWS).withColumn("more", F.lit(True))  # as the edges, so that these don't move for it
        self.edges = bucketed(edges.join(goes_on, "b", "left").select("a", "b", F.coalesce("more", F.lit(False)).alias("more")), "a", n, STEP_ROWS)
        inner = cut(self.edges.where("more").select("a", "b"))
        self.upper = cut(inner.select("a").distinct())
        self.plain = self.edges.join(self.upper, "a", "left_anti").select("a", "b")
        roots = roots.join(self.upper, F.col("id") == F.col("a")).select("id").distinct()
        near = reach(rooted(roots), inner, depth, stored=True)
        last = near.where(F.col("hop") < depth).select("root", F.col("node").alias("a"), "hop")
        ends = self.edges.where("not more").select("a", "b")
        met = last.groupBy("a").agg(F.count("*").alias("roots")).join(ends.groupBy("a").agg(F.count("*").alias("ends")), "a").agg(F.sum(F.col("roots") * F.col("ends")).alias("n")).first().n
        far = dealt(last.join(ends, "a").select("root", F.col("b").alias("node"), (F.col("hop") + 1).alias("hop")), "node", rows=met or 0, each=STEP_ROWS)
        self.pairs = near.where("hop > 0").unionByName(cut(far.groupBy("root", "node").agg(F.min("hop").alias("hop"))))

    def of_roots(self, depth: int) -> DataFrame:
        """(id, n): nodes that a root reaches in `depth` steps; nodes that aren't roots may be among them."""
        n = F.count("*").alias("n")
        far = self.pairs.where(F.col("hop") <= depth).groupBy(F.col("root").alias("id")).agg(n)
        return self.plain.groupBy(F.col("a").alias("id")).agg(n).unionByName(far)

    def of_nodes(self, roots: DataFrame, depth: int) -> DataFrame:
        """(id, n): from how many of some of the roots (id, each once) a node is reached in `depth` steps."""
        upper = cut(roots.join(self.upper, F.col("id") == F.col("a")).select(F.col("id").alias("root")))
        far = self.pairs.where(F.col("hop") <= depth).join(upper, "root", "left_semi").select(F.col("node").alias("id"))
        near = self.plain.join(roots.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id"))
        return far.unionByName(near).groupBy("id").agg(F.count("*").alias("n"))


def closed(rows: DataFrame, need: str) -> DataFrame:
    """Rows (id, need, ...) whose needed row survives as well, until nothing changes; a null need is met."""
    n = rows.count()
    while True:
        kept = cut(rows.join(rows.select(F.col("id").alias(need)), need, "left_semi").unionByName(rows.where(F.col(need).isNull()).select(need, *[c for c in rows.columns if c != need])))
        if (m := kept.count()) == n:
            return kept
        rows, n = kept, m


def water_fill(needs: DataFrame, budget: int) -> DataFrame:
    """needs (id, need) of a bounded set of focal nodes: grants that share a budget, none above its need, the rest level."""
    w = Window.orderBy("need", "id")
    rows = needs.withColumn("k", F.row_number().over(w)).withColumn("before", F.coalesce(F.sum("need").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("m", F.count("*").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    level = F.floor((F.lit(budget) - F.col("before")) / (F.col("m") - F.col("k") + 1))
    rows = rows.withColumn("level", F.when(level <= F.col("need"), level))
    line = F.first("level", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.select("id", "need", F.least("need", F.coalesce(line, "need")).alias("granted"))


# How many nodes and relations the search for traffic may look at.
TRAFFIC_NODES, TRAFFIC_EDGES = 4096, 32768


def traffic(focal: DataFrame, entities: DataFrame, relations: DataFrame, intents: DataFrame, depth: int, now, nodes: int | None = TRAFFIC_NODES, edges: int | None = TRAFFIC_EDGES) -> DataFrame:
    """(root, intent, proximity, distance): how near intents (intent, kind, scope, expires) are to focal entities (id).

    direct: a scope at most one step along outgoing dependencies away; same_file: an entity of the root's file, or that
    file; downstream: further away. A file (kind file) is as far as the nearest entity reached in it. An intent's best
    scope counts; expired ones are left out. Steps into unknown entities don't count. Fails where a root needs more nodes,
    or all relations out of them, than the budgets on the average; without budgets (None) it looks at all there is.
    """
    ids = entities.select(F.col("id").alias("b"))
    got = reach(rooted(focal.join(entities, "id", "left_semi")), edges_of(relations, "out", IMPACT_KINDS).join(ids, "b", "left_semi").select("a", "b"), depth)
    seen = relations.join(got.where(F.col("hop") < depth).select(F.col("node").alias("src")), "src")
    for what, rows, most in (("node", got, nodes), ("edge", seen, edges)):
        if most is not None and (n := rows.select(F.lit(1)).limit(focal.count() * most + 1).count()) > focal.count() * most:
            raise ValueError(f"traffic: {what} budget exceeded ({n})")
    file = entities.select(F.col("id").alias("node"), "file")
    at = got.join(file, "node")
    own = at.where("hop = 0 and file is not null").select("root", F.col("file").alias("own"))
    near = F.when(F.col("hop") <= 1, 0).otherwise(2)
    row = lambda df, kind, scope, rank, distance: df.select("root", F.lit(kind).alias("kind"), F.col(scope).alias("scope"), rank.alias("rank"), distance.alias("distance"))
    by_file = at.where("hop > 0 and file is not null").groupBy("root", "file").agg(F.min("hop").alias("hop"))
    by_file = by_file.join(own.select("root", F.col("own").alias("file")), ["root", "file"], "left_anti")
    targets = row(got, "entity", "node", near, F.col("hop")).unionByName(row(by_file, "file", "file", near, F.col("hop")))
    same = F.lit(1), F.lit(0)
    targets = targets.unionByName(row(own, "file", "own", *same)).unionByName(row(own.join(file, F.col("own") == F.col("file")), "entity", "node", *same))
    live = intents.where(F.col("expires").isNull() | (F.col("expires") >= now)).select("intent", "kind", "scope")
    best = live.join(targets, ["kind", "scope"]).groupBy("root", "intent").agg(F.min(F.struct("rank", "distance")).alias("b"))
    name = F.when(F.col("b.rank") == 0, "direct").when(F.col("b.rank") == 1, "same_file").otherwise("downstream")
    return best.select("root", "intent", name.alias("proximity"), F.col("b.distance").alias("distance"))

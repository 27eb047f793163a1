"""Findings of a review over the whole graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import cut
from .filters import impact_steps
from .graph import Dependents

# How deep and wide a public entity's dependents may be, and how deep findings spread.
DEEP, WIDE, SPREAD = 5, 20, 10


def security_findings(entities: DataFrame, relations: DataFrame, propagate: bool = True) -> DataFrame:
    """(severity, category, entity, n) of entities (id, kind, visibility) and relations (id, kind, src, dst).

    untested-api: endpoints that no Tests relation touches; orphaned-public: public functions and methods without calls
    or tests; high-fan-out: public entities with more than WIDE dependents within DEEP steps, n of them; dead-event: event
    contracts that nothing else consumes; encapsulation-leak: public entities that call private ones, n times;
    transitive-dependency: what depends on n other entities found so far within SPREAD steps.
    """
    relations = cut(relations.select("kind", "src", "dst"))
    tested = relations.where("kind = 'Tests'").select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    called = relations.where("kind = 'Calls'").select(F.col("dst").alias("id")).distinct()
    consumed = relations.where("kind = 'ConsumesContract' and src <> dst").select(F.col("dst").alias("id")).distinct()
    public = entities.where("visibility = 'Public'").select("id", "kind")

    def found(rows, severity, category, n=None):
        return rows.select(F.lit(severity).alias("severity"), F.lit(category).alias("category"), F.col("id").alias("entity"), (F.col(n) if n else F.lit(1)).cast("long").alias("n"))

    private = entities.where("visibility = 'Private'").select(F.col("id").alias("dst"))
    leaks = relations.where("kind = 'Calls'").join(private, "dst", "left_semi").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")).join(public, "id", "left_semi")
    out = found(entities.where("kind = 'ApiEndpoint'").join(tested, "id", "left_anti"), "high", "untested-api")
    for rows in (
        found(public.where("kind in ('Function', 'Method')").join(called, "id", "left_anti").join(tested, "id", "left_anti"), "low", "orphaned-public"),
        found(entities.where("kind = 'EventContract'").join(consumed, "id", "left_anti"), "medium", "dead-event"),
        found(leaks, "low", "encapsulation-leak", "n"),
    ):
        out = out.unionByName(rows)
    out = cut(out)
    dependents = Dependents(impact_steps(relations), public.select("id").unionByName(out.select(F.col("entity").alias("id"))), max(DEEP, SPREAD))
    fan = dependents.of_roots(DEEP).where(F.col("n") > WIDE).join(public, "id", "left_semi")
    out = out.unionByName(cut(found(fan, "medium", "high-fan-out", "n")))
    if not propagate:
        return out
    after = dependents.of_nodes(out.select(F.col("entity").alias("id")).distinct(), SPREAD)
    return out.unionByName(found(after, "info", "transitive-dependency", "n"))


def decisions(reviews: DataFrame, findings: DataFrame) -> DataFrame:
    """(review, status, blocking, attention) of reviews (review, approvals) and findings (review, blocking).

    Blocked by a blocking finding, or by more than two others where more than one approval is needed; attention where
    there is any finding or an approval is needed; else pass.
    """
    n = findings.groupBy("review").agg(F.count(F.when(F.col("blocking"), 1)).alias("blocking"), F.count(F.when(~F.col("blocking"), 1)).alias("attention"))
    rows = reviews.join(n, "review", "left").fillna(0, ["blocking", "attention"])
    blocked = (F.col("blocking") > 0) | (F.col("approvals") > 1) & (F.col("attention") > 2)
    status = F.when(blocked, "blocked").when((F.col("attention") > 0) | (F.col("approvals") > 0), "needs_attention").otherwise("pass")
    return rows.select("review", status.alias("status"), "blocking", "attention")


def unapproved(got: DataFrame, changes: DataFrame, approvals: DataFrame, actors: DataFrame) -> DataFrame:
    """(root, change, author): changes of an ancestry (root, node) with a parent that no human has approved.

    approvals (change, actor, decision); actors (actor, kind): an actor that isn't known is no human.
    """
    human = approvals.where("decision = 'approved'").join(actors.where("kind = 'Human'"), "actor", "left_semi").select(F.col("change").alias("id"))
    open_ = changes.where("parent is not null").join(human, "id", "left_anti").select(F.col("id").alias("node"), "author")
    return got.select("root", "node").join(open_, "node").select("root", F.col("node").alias("change"), "author")


def release_coverage(branches: DataFrame, states: DataFrame) -> DataFrame:
    """(branch, entities, covered, missing, share): what is proven of the entities at the very source of a release.

    No verification run is bound to a source yet, so none of its entities counts as covered; an empty source lacks
    nothing and has a share of 1.
    """
    n = states.groupBy("branch").agg(F.count("*").alias("entities"))
    rows = branches.select("branch").join(n, "branch", "left").fillna(0, ["entities"])
    return rows.select("branch", "entities", F.lit(0).cast("long").alias("covered"), F.col("entities").alias("missing"), F.when(F.col("entities") > 0, 0.0).otherwise(1.0).alias("share"))


def release_check(branches: DataFrame, states: DataFrame, waiting: DataFrame, proof: bool = False, approval: bool = False, force: bool = False) -> DataFrame:
    """(branch, entities, covered, missing, share, waiting, blockers, ok) of branches (branch, source, head, expected).

    states (branch, id): entities at the source; waiting (branch, change): unapproved changes. Blocks where the number of
    entities isn't the expected one (null: any), coverage is below a half (unless forced), proof or an approval that is
    asked for is missing, or the branch has moved on from the source or is gone.
    """
    w = waiting.groupBy("branch").agg(F.count("*").alias("waiting"))
    rows = branches.join(release_coverage(branches, states), "branch").join(w, "branch", "left").fillna(0, ["waiting"])
    why = [(F.col("expected") != F.col("entities"), "entity_count"), (F.col("share") < 0.5, "coverage") if not force else None, (F.col("missing") > 0, "proof") if proof else None, (F.col("waiting") > 0, "approval") if approval else None, (F.col("head").isNull(), "branch_gone"), (F.col("head") != F.col("source"), "branch_moved")]
    blockers = F.concat_ws(",", *[F.when(c, name) for c, name in filter(None, why)])
    return rows.select("branch", "entities", "covered", "missing", "share", "waiting", blockers.alias("blockers"), (blockers == "").alias("ok"))


# How many audit events are looked through, how many of them an entity shows, the longest page.
AUDIT_SCAN, AUDIT_SHOWN, PAGE = 512, 20, 200


def provenance(history: DataFrame, approvals: DataFrame, audit: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    """(entity, changes, latest, page, next_offset, approvals, audit): what is known of where each entity comes from.

    history (entity, change, at), newest first, ids break ties; page: changes offset .. offset + limit (1 to PAGE), as
    text. Approvals (change, ...) count on the latest change. Of the last AUDIT_SCAN events of audit (event, entity,
    change, at) those of the entity or of one of its changes count, AUDIT_SHOWN at most.
    """
    limit = min(max(limit, 1), PAGE)
    w = Window.partitionBy("entity")
    rows = history.withColumn("n", F.row_number().over(w.orderBy(F.desc("at"), F.desc("change")))).withColumn("total", F.count("*").over(w))
    on_page = (F.col("n") > offset) & (F.col("n") <= offset + limit)
    page = rows.where((F.col("n") == 1) | on_page).groupBy("entity").agg(
        F.max("total").alias("changes"), F.max(F.when(F.col("n") == 1, F.col("change"))).alias("latest"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(on_page, F.struct("n", "change")))), lambda x: x["change"].cast("string")), ",").alias("page"),
    )
    seen = audit.orderBy(F.desc("at"), F.desc("event")).limit(AUDIT_SCAN)
    of_change = seen.where("entity is null").select("event", "change").join(history.select("entity", "change"), "change").select("entity", "event")
    events = seen.where("entity is not null").select("entity", "event").unionByName(of_change).distinct().groupBy("entity").agg(F.least(F.count("*"), F.lit(AUDIT_SHOWN)).alias("audit"))
    n = approvals.groupBy(F.col("change").alias("latest")).agg(F.count("*").alias("approvals"))
    after = F.when(F.col("changes") > offset + limit, F.lit(offset + limit)).cast("long")
    return page.join(n, "latest", "left").join(events, "entity", "left").fillna(0, ["approvals", "audit"]).select("entity", "changes", "latest", "page", after.alias("next_offset"), "approvals", F.col("audit").cast("long").alias("audit"))


def review_records(reviews: DataFrame, decisions: DataFrame, notes: DataFrame, discussions: DataFrame, assigned: DataFrame, state: str | None = None) -> DataFrame:
    """reviews (review, created) with their state, the counts of all that belongs to them (each with review), and current reviewers; newest first.

    decisions (review, state, at, id): the latest one's state, in lower case, is the review's; null before any.
    """
    count = lambda df, name: df.groupBy("review").agg(F.count("*").alias(name))
    last = decisions.groupBy("review").agg(F.count("*").alias("decisions"), F.lower(F.max_by("state", F.struct("at", "id"))).alias("state"))
    rows = reviews.join(last, "review", "left").join(count(notes, "notes"), "review", "left").join(count(discussions, "discussions"), "review", "left").join(count(assigned, "reviewers"), "review", "left")
    rows = rows.fillna(0, ["decisions", "notes", "discussions", "reviewers"])
    return (rows.where(F.col("state") == state) if state else rows).orderBy(F.desc("created"), "review")


def proof_coverage(subjects: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: total, covered, ratio, runs, with_any_run, trusted of subjects (id) and runs (id, status).

    A subject is covered by a passing run. Without any run of whatever status the number says nothing of the subjects
    (trusted is false). Nothing has a ratio of 0.
    """
    seen = runs.groupBy("id").agg(F.count("*").alias("runs"), F.max((F.col("status") == "passing").cast("int")).alias("ok"))
    rows = subjects.select("id").distinct().join(seen, "id", "left").agg(F.count("*").alias("total"), F.count(F.when(F.col("ok") == 1, 1)).alias("covered"), F.coalesce(F.sum("runs"), F.lit(0)).alias("runs"), F.count("runs").alias("with_any_run"))
    return rows.select("total", "covered", F.round(F.when(F.col("total") > 0, F.col("covered") / F.col("total")).otherwise(0.0), 6).alias("ratio"), "runs", "with_any_run", (F.col("runs") > 0).alias("trusted"))


def verification_plan(starts: DataFrame, impacted: DataFrame, tests: DataFrame, work: DataFrame, verifies: DataFrame, runs: DataFrame) -> DataFrame:
    """(root, part, id, status): what to run for starts (id) and what that proves; impacted (root, node).

    tests (entity, test), work (entity, work), verifies (work, test), runs (test, at, status). test: tests of the start and of
    what it touches, direct or through work on them, with the status of the latest run (null before any). entity: the
    start, and what has tests among these. work: what one of these tests verifies.
    """
    scope = cut(impacted.select("root", "node").unionByName(starts.select(F.col("id").alias("root"), F.col("id").alias("node"))).distinct())
    on = scope.join(work.withColumnRenamed("entity", "node"), "node").distinct()
    direct = scope.join(tests.withColumnRenamed("entity", "node"), "node").select("root", "node", "test")
    chosen = cut(direct.unionByName(on.join(verifies, "work").select("root", "node", "test")).distinct())
    last = runs.groupBy("test").agg(F.max_by("status", "at").alias("status"))
    none = F.lit(None).cast("string")
    out = chosen.select("root", "test").distinct().join(last, "test", "left").select("root", F.lit("test").alias("part"), F.col("test").cast("string").alias("id"), "status")
    proved = chosen.select("root", F.col("node").alias("id")).unionByName(starts.select(F.col("id").alias("root"), "id")).distinct()
    out = out.unionByName(proved.select("root", F.lit("entity").alias("part"), F.col("id").cast("string").alias("id"), none.alias("status")))
    done = on.join(verifies, "work").join(chosen.select("root", "test").distinct(), ["root", "test"], "left_semi").select("root", "work").distinct()
    return out.unionByName(done.select("root", F.lit("work").alias("part"), F.col("work").cast("string").alias("id"), none.alias("status")))

"""Queries A, K and L: sources, history and review, and the change feed."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import artifacts as art
from ..operators import graph as g
from ..operators import history as h
from ..operators import review as rv
from ..operators import stats as st
from ..sources.store import Store, checkpoint_dir, cut, overlay, table
from ..streaming import feed, incremental
from .filters_and_joins import ANCESTRY, E, G, OLD_NEW, g6_current_assignments, old_new, two_heads
from .model import CHANGES_SQL, LOG_SQL, entities, entity_log, relations
from .registry import query

STORE_SQL = """base AS (SELECT c_custkey AS id, c_mktsegment AS segment, c_acctbal AS balance FROM customer WHERE c_custkey % 5 > 0),
d1 AS (SELECT c_custkey AS id, c_mktsegment AS segment, c_acctbal + 1 AS balance, CASE WHEN c_custkey % 10 = 3 THEN 'removed' ELSE 'modified' END AS op, 2 AS gen FROM customer WHERE c_custkey % 10 IN (3, 4)), d2 AS (SELECT c_custkey AS id, c_mktsegment AS segment, c_acctbal - 1 AS balance, 'added' AS op, 3 AS gen FROM customer WHERE c_custkey % 20 IN (0, 3))"""


def filled_store(spark, d):
    """A snapshot and two deltas, written through the store."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    store = Store(spark, f"{checkpoint_dir(spark)}/store-{uuid.uuid4().hex}")
    g = store.save_snapshot(c.where("id % 5 > 0"), 0)
    g = store.save_delta(c.where("id % 10 in (3, 4)").withColumn("balance", F.col("balance") + 1).withColumn("op", F.when(F.col("id") % 10 == 3, "removed").otherwise("modified")), g)
    store.save_delta(c.where("id % 20 in (0, 3)").withColumn("balance", F.col("balance") - 1).withColumn("op", F.lit("added")), g)
    return store


@query(f"WITH {STORE_SQL} SELECT gen AS generation, op, count(*) AS n, round(sum(balance), 2) AS balance FROM (FROM d1 UNION ALL FROM d2) GROUP BY ALL", name="a2_a3_a4_deltas_since")
def a4_deltas_since(spark, d):
    rows = filled_store(spark, d).deltas(1)
    return rows.groupBy(F.col("generation").cast("int").alias("generation"), "op").agg(F.count("*").alias("n"), F.round(F.sum("balance"), 2).alias("balance"))


@query(f"WITH {STORE_SQL}, last AS (SELECT * FROM (FROM d1 UNION ALL FROM d2) QUALIFY row_number() OVER (PARTITION BY id ORDER BY gen DESC) = 1) SELECT id, segment, round(balance, 2) AS balance FROM base WHERE id NOT IN (SELECT id FROM last) UNION ALL SELECT id, segment, round(balance, 2) FROM last WHERE op <> 'removed'", name="a1_a6_k9_recovery")
def a6_recovery(spark, d):
    return filled_store(spark, d).recover("id").select("id", "segment", F.round("balance", 2).alias("balance"))


@query("SELECT DISTINCT source AS repo FROM documents", name="a7_list_repositories")
def a7_list_repositories(spark, d):
    return table(spark, d, "documents").select(F.col("source").alias("repo")).distinct()


@query(E + "SELECT id, CASE WHEN line % 10 = 1 THEN 'Edited' ELSE kind END AS kind FROM entities WHERE line % 10 <> 2", name="a8_session_overlay")
def a8_session_overlay(spark, d):
    e = entities(spark, d).select("id", "kind", "line")
    session = e.where("line % 10 in (1, 2)").withColumn("kind", F.lit("Edited")).withColumn("gone", F.col("line") % 10 == 2)
    return overlay(e, session, "id").select("id", "kind")


@query(G + "SELECT id, kind, name, coalesce(n, 0) AS incoming FROM entities LEFT JOIN (SELECT dst AS id, count(DISTINCT src) AS n FROM relations GROUP BY dst) USING (id)", name="a10_compact_index")
def a10_compact_index(spark, d):
    incoming = st.partners(relations(spark, d), "dst", "src", "incoming")
    return entities(spark, d).select("id", "kind", "name").join(incoming, "id", "left").select("id", "kind", "name", F.coalesce("incoming", F.lit(0)).alias("incoming"))


SOURCES_SQL = "(" + ", ".join(f"'{x}'" for x in art.SOURCES) + ")"


@query(E + f"SELECT CASE WHEN regexp_extract(file, '\\.([A-Za-z0-9]+)$', 1) IN {SOURCES_SQL} THEN 'semantic' ELSE 'opaque' END AS tier, regexp_extract(file, '\\.([A-Za-z0-9]+)$', 1) AS extension, count(*) AS files FROM (SELECT DISTINCT file FROM entities WHERE file IS NOT NULL UNION ALL SELECT url FROM pages WHERE url IS NOT NULL) GROUP BY ALL", name="a14_a15_coverage")
def a14_coverage(spark, d):
    """Of the entities' files and of all pages."""
    files = entities(spark, d).where("file is not null").select("file").distinct().unionByName(table(spark, d, "pages").where("url is not null").select(F.col("url").alias("file")))
    return art.coverage(files, "file")


@query(r"SELECT doc_id, CASE WHEN trim(regexp_replace(substr(text, 1, 120), '[ \t\n\r\f\x0b]+', ' ', 'g')) <> '' THEN trim(regexp_replace(substr(text, 1, 120), '[ \t\n\r\f\x0b]+', ' ', 'g')) END AS preview FROM documents", name="a16_text_preview")
def a16_text_preview(spark, d):
    return table(spark, d, "documents").select("doc_id", art.preview(F.col("text")).alias("preview"))


@query(r"SELECT conv_id, line::INTEGER AS line, regexp_extract(l, '\b(De|Th|The|In)\b[:\s]*([^\n]*)', 1) AS kind, trim(regexp_extract(l, '\b(De|Th|The|In)\b[:\s]*([^\n]*)', 2)) AS note FROM (SELECT conv_id, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM conversations WHERE regexp_matches(text, '^[ -~\n]*$')) WHERE regexp_matches(l, '\b(De|Th|The|In)\b')", name="a17_notes")
def a17_notes(spark, d):
    """Lines with marker words; the data's own words stand in for TODO and the like, over texts of ASCII letters."""
    texts = table(spark, d, "conversations").where(F.col("text").rlike(r"\A[ -~\n]*\z"))
    return art.notes(texts, "conv_id", words=("De", "Th", "The", "In"))


MANIFEST = "manifests AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'a/Cargo.toml' WHEN 1 THEN 'b/package.json' ELSE 'c/requirements.txt' END AS path FROM pages)"


@query(f"WITH {MANIFEST} SELECT path || page_id AS file, CASE page_id % 3 WHEN 0 THEN 'serde' || page_id % 7 WHEN 1 THEN 'left-pad' || page_id % 5 ELSE 'numpy' || page_id % 4 END AS name, CASE page_id % 3 WHEN 0 THEN 'cargo' WHEN 1 THEN 'npm' ELSE 'pip' END AS source FROM manifests UNION ALL SELECT path || page_id, 'tokio', 'cargo' FROM manifests WHERE page_id % 3 = 0", name="a18_manifest_dependencies")
def a18_manifest_dependencies(spark, d):
    p = F.col("page_id")
    s = lambda n: (p % n).cast("string")
    path = F.when(p % 3 == 0, "a/Cargo.toml").when(p % 3 == 1, "b/package.json").otherwise("c/requirements.txt")
    text = F.when(p % 3 == 0, F.concat(F.lit("[dependencies]\nserde"), s(7), F.lit(' = "1.0"\ntokio = { version = "1" }\n'))).when(p % 3 == 1, F.concat(F.lit('{"dependencies": {"left-pad'), s(5), F.lit('": "^1.3.0"}}'))).otherwise(F.concat(F.lit("numpy"), s(4), F.lit(">=1.2\n")))
    files = table(spark, d, "pages").select(F.concat_ws("/", p.cast("string"), path).alias("path"), text.alias("text"))
    found = art.dependencies(files)
    return found.select(F.concat(F.regexp_replace("path", "^[0-9]+/", ""), F.regexp_extract("path", "^[0-9]+", 0)).alias("file"), "name", "source")


@query(f"WITH {LOG_SQL} SELECT entity, ord, value, note FROM (SELECT * FROM entity_log WHERE ord <= 6000 QUALIFY row_number() OVER (PARTITION BY entity ORDER BY ord DESC) = 1) WHERE op <> 'removed'", name="k1_state_at")
def k1_state_at(spark, d):
    return h.state_at(entity_log(spark, d), 6000)


@query(f"WITH {LOG_SQL}, tree AS (SELECT 'docs/' || entity AS path, ord AS doc_id, op FROM (SELECT * FROM entity_log WHERE ord <= 6000 QUALIFY row_number() OVER (PARTITION BY entity ORDER BY ord DESC) = 1) WHERE op <> 'removed') SELECT path, t.doc_id AS blob, d.doc_id IS NOT NULL AS readable, length(text) AS chars, sha256(text) AS hash FROM tree t LEFT JOIN documents d USING (doc_id) WHERE starts_with(path, 'docs/u:1')", name="a21_artifacts_at_change")
def a21_artifacts_at_change(spark, d):
    """The artifacts below a path as of a change, with what their content is; blobs that nobody has are listed, not readable."""
    tree = h.state_at(entity_log(spark, d), 6000).select(F.concat(F.lit("docs/"), "entity").alias("path"), F.col("ord").alias("blob"))
    blobs = table(spark, d, "documents").select(F.col("doc_id").alias("blob"), F.lit(True).alias("there"), F.length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("hash"))
    return tree.where(F.col("path").startswith("docs/u:1")).join(blobs, "blob", "left").select("path", "blob", F.coalesce("there", F.lit(False)).alias("readable"), "chars", "hash")


@query(f"WITH {LOG_SQL} SELECT entity, ord, op, n::INTEGER AS n, total FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ord DESC) AS n, count(*) OVER (PARTITION BY entity) AS total FROM entity_log) WHERE n <= 3", name="k2_k5_f8_entity_history")
def k2_entity_history(spark, d):
    w = Window.partitionBy("entity")
    rows = entity_log(spark, d).withColumn("n", F.row_number().over(w.orderBy(F.desc("ord")))).withColumn("total", F.count("*").over(w))
    return rows.where("n <= 3").select("entity", "ord", "op", "n", "total")


@query(f"WITH {LOG_SQL} SELECT entity, introduced, ended, value FROM (SELECT entity, op, ord AS introduced, lead(ord) OVER (PARTITION BY entity ORDER BY ord) AS ended, value FROM entity_log) WHERE op <> 'removed'", name="k3_revisions")
def k3_revisions(spark, d):
    return h.revisions(entity_log(spark, d))


FIELDS = ("visibility", "signature", "body")


@query(E + f", {OLD_NEW} SELECT id, field, old, new FROM (" + " UNION ALL ".join(f"SELECT o.id, '{f}' AS field, o.{f}::VARCHAR AS old, n.{f}::VARCHAR AS new FROM old o JOIN new n ON o.id = n.id WHERE o.{f} IS DISTINCT FROM n.{f}" for f in FIELDS) + ")", name="k7_k27_field_changes")
def k27_field_changes(spark, d):
    return h.field_changes(*old_new(spark, d), "id", list(FIELDS))


@query(E + f", {OLD_NEW}, e AS (SELECT CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' ELSE 'modified' END AS change FROM old o FULL JOIN new n ON o.id = n.id WHERE o.id IS NULL OR n.id IS NULL OR o.visibility <> n.visibility OR o.signature <> n.signature OR o.body <> n.body), t AS (SELECT file AS path, count(*) AS entries FROM entities WHERE file IS NOT NULL GROUP BY file) SELECT 'entities' AS collection, change, count(*) AS n FROM e GROUP BY change UNION ALL SELECT 'files', CASE WHEN entries % 5 = 0 THEN 'added' ELSE 'removed' END, count(*) FROM t WHERE (entries % 5 > 0) <> (entries % 3 > 0) AND entries % 15 > 0 GROUP BY ALL", name="k8_graph_delta")
def k8_graph_delta(spark, d):
    """The diff of several tables side by side."""
    t = entities(spark, d).where("file is not null").groupBy(F.col("file").alias("path")).agg(F.count("*").alias("entries"))
    parts = {"entities": h.diff(*old_new(spark, d), "id", list(FIELDS)), "files": h.diff(t.where("entries % 5 > 0"), t.where("entries % 3 > 0"), "path", ["entries"])}
    rows = [x.groupBy("change").agg(F.count("*").alias("n")).select(F.lit(k).alias("collection"), "change", "n") for k, x in parts.items()]
    return rows[0].unionByName(rows[1])


@query(f"WITH {LOG_SQL} SELECT ord, entity, CASE op WHEN 'added' THEN 'removed' WHEN 'removed' THEN 'added' ELSE op END AS op, value AS old, before AS new FROM (SELECT *, lag(value) OVER (PARTITION BY entity ORDER BY ord) AS before FROM entity_log) WHERE ord > 9000", name="k10_inverse_delta")
def k10_inverse_delta(spark, d):
    log = entity_log(spark, d).withColumn("old", F.lag("value").over(Window.partitionBy("entity").orderBy("ord"))).withColumn("new", F.col("value"))
    return h.inverse(log.where("ord > 9000").select("ord", "entity", "op", "old", "new"))


@query("""WITH base AS (SELECT p_partkey AS id, p_size AS v FROM part WHERE p_partkey % 9 > 0), ours AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN p_size + 1 ELSE p_size END AS v FROM part WHERE p_partkey % 7 > 0), theirs AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 6 = 0 THEN p_size + 2 WHEN p_partkey % 8 = 0 THEN p_size + 1 ELSE p_size END AS v FROM part WHERE p_partkey % 5 > 0)
SELECT id, CASE WHEN a.v IS NOT DISTINCT FROM b.v THEN CASE WHEN a.v IS NOT DISTINCT FROM o.v THEN 'unchanged' ELSE 'same_change' END WHEN a.v IS NOT DISTINCT FROM o.v THEN 'take_theirs' WHEN b.v IS NOT DISTINCT FROM o.v THEN 'take_ours' WHEN o.v IS NULL THEN 'added_both_sides' WHEN a.v IS NULL THEN 'removed_ours_changed_theirs' WHEN b.v IS NULL THEN 'changed_ours_removed_theirs' ELSE 'changed_both_sides' END AS outcome FROM base o FULL JOIN ours a USING (id) FULL JOIN theirs b USING (id)""", name="k12_k13_three_way_merge")
def k12_three_way_merge(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("value"))
    i, v = F.col("id"), F.col("value")
    ours = p.where(i % 7 > 0).withColumn("value", F.when(i % 4 == 0, v + 1).otherwise(v))
    theirs = p.where(i % 5 > 0).withColumn("value", F.when(i % 6 == 0, v + 2).when(i % 8 == 0, v + 1).otherwise(v))
    return h.merge3(p.where(i % 9 > 0), ours, theirs)


@query(E + ", files AS (SELECT file FROM entities WHERE role = 'Test' AND file IS NOT NULL GROUP BY file) SELECT e.file, count(*) AS entities FROM entities e JOIN files USING (file) GROUP BY e.file", name="k19_l6_reindex_scope")
def k19_reindex_scope(spark, d):
    e = entities(spark, d)
    return e.join(e.where("role = 'Test'").select("file"), "file", "left_semi").groupBy("file").agg(F.count("*").alias("entities"))


@query(E + ", notes AS (SELECT 'p:' || l_partkey AS id, max(l_quantity)::INTEGER AS anchor FROM lineitem GROUP BY l_partkey) SELECT id, CASE WHEN e.id IS NULL THEN 'orphaned' WHEN anchor = e.size % 51 THEN 'fresh' ELSE 'stale' END AS staleness FROM notes LEFT JOIN (SELECT id, size FROM entities WHERE role <> 'Test') e USING (id)", name="k22_annotation_staleness")
def k22_annotation_staleness(spark, d):
    notes = table(spark, d, "lineitem").groupBy(F.concat(F.lit("p:"), F.col("l_partkey").cast("string")).alias("id")).agg(F.max("l_quantity").cast("int").alias("anchor"))
    now = entities(spark, d).where("role <> 'Test'").select("id", (F.col("size") % 51).alias("current"))
    return notes.join(now, "id", "left").select("id", F.when(F.col("current").isNull(), "orphaned").when(F.col("anchor") == F.col("current"), "fresh").otherwise("stale").alias("staleness"))


@query("WITH l AS (SELECT o_orderkey AS a, o_custkey AS b, CASE o_orderpriority WHEN '1-URGENT' THEN 'blocks' WHEN '2-HIGH' THEN 'parent_of' ELSE 'implements' END AS type FROM orders) SELECT b AS work, count(*) FILTER (type = 'blocks') AS blockers, count(*) FILTER (type = 'parent_of') AS parents, count(*) FILTER (type = 'implements') AS implementors FROM l GROUP BY b", name="k23_work_graph")
def k23_work_graph(spark, d):
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "blockers").when(F.col("o_orderpriority") == "2-HIGH", "parents").otherwise("implementors")
    links = table(spark, d, "orders").select(F.col("o_custkey").alias("work"), kind.alias("type"))
    return links.groupBy("work").agg(*[F.count(F.when(F.col("type") == t, 1)).alias(t) for t in ("blockers", "parents", "implementors")])


@query("WITH a AS (SELECT event_id AS change, user_id AS actor FROM events WHERE event_type = 'purchase'), g AS (SELECT user_id AS delegate, user_id % 10 AS principal FROM events WHERE event_type = 'signup' GROUP BY ALL) SELECT a.actor, count(*) AS approvals, count(DISTINCT g.principal) AS delegations FROM a LEFT JOIN g ON g.delegate = a.actor GROUP BY a.actor", name="k25_approvals")
def k25_approvals(spark, d):
    e = table(spark, d, "events")
    a = e.where("event_type = 'purchase'").groupBy(F.col("user_id").alias("actor")).agg(F.count("*").alias("approvals"))
    g = e.where("event_type = 'signup'").groupBy(F.col("user_id").alias("actor")).agg(F.count_distinct(F.col("user_id") % 10).alias("delegations"))
    return a.join(g, "actor", "left").select("actor", "approvals", F.coalesce("delegations", F.lit(0)).alias("delegations"))


@query("WITH turns AS (SELECT conv_id, count(*) FILTER (role = 'user') AS asked, count(*) FILTER (role = 'assistant') AS answered, max(turn) AS last_turn, max_by(role, turn * 1000 + len(role)) AS last_role FROM conversations GROUP BY conv_id) SELECT * FROM turns", name="b17_k26_review_records")
def k26_review_records(spark, d):
    """A conversation as a review: notes by side, and its latest."""
    c = table(spark, d, "conversations")
    n = lambda r: F.count(F.when(F.col("role") == r, 1))
    return c.groupBy("conv_id").agg(n("user").alias("asked"), n("assistant").alias("answered"), F.max("turn").alias("last_turn"), F.max_by("role", F.col("turn") * 1000 + F.length("role")).alias("last_role"))


@query("SELECT user_id AS session, sum(CASE WHEN ts + INTERVAL 12 HOUR < TIMESTAMP '2024-01-15' THEN 1 ELSE 0 END)::BIGINT AS expired, count(*) AS intents FROM events GROUP BY user_id", name="l7_lease_expiry")
def l7_lease_expiry(spark, d):
    gone = F.col("ts") + F.expr("INTERVAL 12 HOURS") < F.lit("2024-01-15").cast("timestamp_ntz")
    return table(spark, d, "events").groupBy(F.col("user_id").alias("session")).agg(F.count(F.when(gone, 1)).alias("expired"), F.count("*").alias("intents"))


def feed_rows(spark, d):
    op = F.when(F.col("event_type") == "signup", "added").when(F.col("event_type") == "error", "removed").otherwise("modified")
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("u:"), F.col("user_id").cast("string")).alias("id"), op.alias("type"), "value", F.col("ts").alias("at"))


FEED_SQL = "feed AS (SELECT event_id AS seq, 'u:' || user_id AS id, CASE event_type WHEN 'signup' THEN 'added' WHEN 'error' THEN 'removed' ELSE 'modified' END AS type, value FROM events)"


@query(f"WITH {FEED_SQL} SELECT seq, id, type FROM feed WHERE type IN ('added', 'removed')", name="l1_l2_feed_filter")
def l1_feed_filter(spark, d):
    return feed.replayed(spark, feed_rows(spark, d), 3, lambda s: feed.only(s, ["added", "removed"]).select("seq", "id", "type"))


@query(f"WITH {FEED_SQL} SELECT id, seq, type, value FROM (SELECT * FROM feed QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1) WHERE type <> 'removed'", name="l3_l5_feed_replica")
def l3_feed_replica(spark, d):
    """A snapshot of the feed's first half, then the feed from before that point on; replays change nothing."""
    rows = feed_rows(spark, d)
    half = rows.agg(F.floor(F.max("seq") / 2).alias("h"))
    early = rows.join(F.broadcast(half))  # one row
    state = feed.replicated(spark, feed.latest(early.where("seq <= h").drop("h")), early.where("seq > h - 100").drop("h"), 3)
    return state.select("id", "seq", "type", "value")


@query(f"WITH {FEED_SQL} SELECT count(*) FILTER (type = 'added') AS added, count(*) FILTER (type = 'modified') AS modified, count(*) FILTER (type = 'removed') AS removed, count(*) AS events, max(seq) AS last_seq FROM feed", name="l4_feed_pass_counts")
def l4_feed_pass_counts(spark, d):
    return feed.replayed(spark, feed_rows(spark, d), 1, lambda s: s.select("seq", "type")).transform(feed.pass_counts)


TREE_SQL = "tree AS (SELECT source, file, entry FROM (SELECT 's' || (event_id % 4) AS source, 'u:' || user_id AS file, arg_max(floor(value / 10)::BIGINT, event_id) AS entry, arg_max(event_type, event_id) AS type FROM events GROUP BY ALL) WHERE type <> 'error')"


@query(f"WITH {TREE_SQL} SELECT source, file, entry, unnest(range(entry % 3 + 1))::INTEGER AS part FROM tree", name="l5_l6_incremental")
def l5_incremental(spark, d):
    """Parts of files kept in step with a feed in three batches, of which one source loses frames: the same as deriving all from the last tree."""
    base = f"{checkpoint_dir(spark)}/incremental-{uuid.uuid4().hex}"
    rows = feed_rows(spark, d).select(F.concat(F.lit("s"), (F.col("seq") % 4).cast("string")).alias("source"), (F.floor(F.col("seq") / 4) + 1).alias("n"), F.col("id").alias("file"), "type", F.floor(F.col("value") / 10).cast("long").alias("entry"), F.col("seq").alias("ord"))
    last = rows.groupBy("source", "file").agg(F.max_by(F.struct("type", "entry"), "ord").alias("l")).where("l.type <> 'removed'").select("source", "file", "l.entry")
    tree, early = cut(last), rows.where("ord < 100").groupBy("source", "file").agg(F.max_by("entry", "ord").alias("entry"))
    frames = rows.where("not (source = 's1' and n between 60 and 90)")
    frames.repartitionByRange(3, "ord").select("source", F.col("n").alias("seq"), "file", "type").write.parquet(f"{base}/in")
    now = [early]
    derived = incremental.Derived(spark, f"{base}/table", lambda: now[0], lambda files: files.select("source", "file", "entry", F.explode(F.sequence(F.lit(0), (F.col("entry") % 3).cast("int"))).alias("part")))
    derived.start()
    now[0] = tree
    incremental.keep_up(spark.readStream.schema(incremental.FRAMES).option("maxFilesPerTrigger", 1).parquet(f"{base}/in"), derived, f"{base}/state")
    return derived.rows().select("source", "file", "entry", "part")


@query(G + "SELECT to_json({'id': id, 'kind': kind, 'file': file}) AS node FROM entities WHERE kind IN ('Module', 'Interface')", name="a22_graph_export_json")
def a22_graph_export_json(spark, d):
    return entities(spark, d).where("kind in ('Module', 'Interface')").select(F.to_json(F.struct("id", "kind", "file"), {"ignoreNullFields": "false"}).alias("node"))




@query(f"WITH {MANIFEST.replace('requirements.txt', 'pyproject.toml')} SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'run' || page_id % 7 WHEN 1 THEN 'cli' ELSE 'tool' || page_id % 4 END AS script, CASE page_id % 3 WHEN 0 THEN 'src/bin/run' || page_id % 7 || '.rs' WHEN 1 THEN './bin/cli.js' ELSE 'pkg.main' END AS module, CASE page_id % 3 WHEN 0 THEN 'main' WHEN 2 THEN 'go' END AS symbol FROM manifests", name="a19_entry_points")
def a19_entry_points(spark, d):
    p = F.col("page_id")
    s = lambda n: (p % n).cast("string")
    path = F.when(p % 3 == 0, "a/Cargo.toml").when(p % 3 == 1, "b/package.json").otherwise("c/pyproject.toml")
    text = F.when(p % 3 == 0, F.concat(F.lit('[[bin]]\nname = "run'), s(7), F.lit('"\n\n[dependencies]\nserde = "1"\n'))).when(p % 3 == 1, F.lit('{"name": "x", "bin": {"cli": "./bin/cli.js"}}')).otherwise(F.concat(F.lit("[project.scripts]\ntool"), s(4), F.lit(' = "pkg.main:go"\n[tool.x]\ny = "a:b"\n')))
    files = table(spark, d, "pages").select(F.concat_ws("/", p.cast("string"), path).alias("path"), text.alias("text"))
    return art.entry_points(files).select(F.regexp_extract("path", "^[0-9]+", 0).cast("long").alias("page_id"), "script", "module", "symbol")


BODIES = "old AS (SELECT l_orderkey AS id, l_linenumber AS n, l_partkey % 50 AS hash, l_partkey % 5 = 0 AS guard FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1), new AS (SELECT id, n, hash, guard FROM old WHERE NOT (id % 4 = 1 AND n = 2) UNION ALL SELECT id, 100, 55, id % 3 = 0 FROM old WHERE id % 2 = 0 AND id % 5 > 0 GROUP BY id)"


@query(f"WITH {BODIES}, c AS (SELECT id, hash, guard, sum(side) AS d FROM (SELECT id, hash, guard, -1 AS side FROM old UNION ALL SELECT id, hash, guard, 1 FROM new) GROUP BY ALL), m AS (SELECT id, sum(greatest(d, 0)) AS added, sum(CASE WHEN guard THEN greatest(d, 0) ELSE 0 END) AS guards, sum(greatest(-d, 0)) AS removed FROM c GROUP BY id), o AS (SELECT coalesce(old.id, new.id) AS id, bool_or(old.hash IS DISTINCT FROM new.hash OR old.guard IS DISTINCT FROM new.guard) AS reordered FROM old FULL JOIN new ON old.id = new.id AND old.n = new.n GROUP BY 1) SELECT id, CASE WHEN NOT reordered THEN 'equivalent' WHEN removed = 0 AND added > 0 AND added = guards THEN 'added_narrowing_guard' WHEN added = 0 AND removed > 0 THEN 'removed_guard_or_widened' ELSE 'other' END AS shape, guards::BIGINT AS guards, removed::BIGINT AS removed FROM m JOIN o USING (id)", name="k15_change_shape")
def k15_change_shape(spark, d):
    line = table(spark, d, "lineitem")
    first = line.groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("long").alias("n")).agg(F.min(F.struct("l_partkey", "l_suppkey")).alias("m"))
    old = first.select("id", "n", (F.col("m.l_partkey") % 50).alias("hash"), (F.col("m.l_partkey") % 5 == 0).alias("guard"))
    more = old.where("id % 2 = 0 and id % 5 > 0").select("id").distinct().select("id", F.lit(100).cast("long").alias("n"), F.lit(55).cast("long").alias("hash"), (F.col("id") % 3 == 0).alias("guard"))
    return h.change_shape(old, old.where("not (id % 4 = 1 and n = 2)").unionByName(more))


MAINLINE = "mainline AS (SELECT event_id AS id, CASE WHEN event_id % 10 = 8 THEN event_id - 2 WHEN event_id > 0 THEN event_id - 1 END AS parent FROM events)"
LOGS = """chain(change, back) AS (SELECT max(id) - 500, 0 FROM mainline UNION ALL SELECT parent, back + 1 FROM chain JOIN mainline ON id = change WHERE parent IS NOT NULL),
elog AS (SELECT e.entity AS id, op, change, -back AS pos FROM entity_log e JOIN chain ON ord = change),
users AS (SELECT count(DISTINCT user_id) AS n FROM events),
rlog AS (SELECT 'u:' || user_id AS src, 'u:' || ((user_id + event_id % 9) % (n + 3)) AS dst, CASE WHEN event_type = 'view' THEN 'removed' ELSE 'added' END AS op, event_id AS change, -back AS pos FROM events JOIN chain ON event_id = change, users WHERE event_type IN ('purchase', 'click') OR event_type = 'view' AND event_id % 4 = 0),
elast AS (SELECT * FROM elog QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos DESC) = 1), rlast AS (SELECT *, src || '>' || dst AS id FROM rlog QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY pos DESC) = 1),
pruned AS (SELECT r.id, min_by(x.change, x.pos) AS change FROM rlast r JOIN elog x ON (x.id = r.src OR x.id = r.dst) AND x.op = 'removed' AND x.pos >= r.pos WHERE r.op = 'added' GROUP BY r.id), alive AS (SELECT id FROM elast WHERE op <> 'removed')"""


def mainline(spark, d):
    """A history whose every tenth change is a branch of its own: (id, parent)."""
    i = F.col("event_id")
    return table(spark, d, "events").select(i.alias("id"), F.when(i % 10 == 8, i - 2).when(i > 0, i - 1).alias("parent"))


def relation_log(spark, d):
    """Relations between users that changes add (purchases, clicks) or take away (some views): (change, id, src, dst, op)."""
    e = table(spark, d, "events")
    n = e.agg(F.count_distinct("user_id").alias("n"))
    rows = e.where("event_type in ('purchase', 'click') or event_type = 'view' and event_id % 4 = 0").join(F.broadcast(n))  # one row
    user = lambda c: F.concat(F.lit("u:"), c.cast("string"))
    src, dst = user(F.col("user_id")), user((F.col("user_id") + F.col("event_id") % 9) % (F.col("n") + 3))
    return rows.select(F.col("event_id").alias("change"), F.concat_ws(">", src, dst).alias("id"), src.alias("src"), dst.alias("dst"), F.when(F.col("event_type") == "view", "removed").otherwise("added").alias("op"))


@query(f"""WITH RECURSIVE {MAINLINE}, {LOG_SQL}, {LOGS}
SELECT 'entity' AS part, id, change, false AS dead FROM elast WHERE op <> 'removed' UNION ALL SELECT 'relation', id, change, false FROM rlast WHERE op = 'added' AND id NOT IN (SELECT id FROM pruned) AND src IN (FROM alive) AND dst IN (FROM alive)
UNION ALL SELECT 'entity', id, change, true FROM elast WHERE op = 'removed' UNION ALL SELECT 'relation', id, change, true FROM rlast WHERE op = 'removed' UNION ALL SELECT 'relation', id, change, true FROM pruned""", name="k1_replay_first_parents")
def k1_replay(spark, d):
    """Graph and tombstones at a change, by replay along its first parents; removed entities take their relations with them."""
    c = mainline(spark, d)
    chain = h.first_parents(c, c.agg((F.max("id") - 500).alias("id")))
    log = entity_log(spark, d).select(F.col("ord").alias("change"), F.col("entity").alias("id"), "op")
    alive, kept, dead = h.resolve_at(chain, log, relation_log(spark, d))
    part = lambda df, name: df.select(F.lit(name).alias("part"), "id", "change", F.lit(False).alias("dead"))
    return part(alive, "entity").unionByName(part(kept, "relation")).unionByName(dead.withColumn("dead", F.lit(True)))


def outcome_sql(o, a, b):
    return f"CASE WHEN {a} IS NOT DISTINCT FROM {b} THEN CASE WHEN {a} IS NOT DISTINCT FROM {o} THEN 'unchanged' ELSE 'same_change' END WHEN {a} IS NOT DISTINCT FROM {o} THEN 'take_theirs' WHEN {b} IS NOT DISTINCT FROM {o} THEN 'take_ours' WHEN {o} IS NULL THEN 'added_both_sides' WHEN {a} IS NULL THEN 'removed_ours_changed_theirs' WHEN {b} IS NULL THEN 'changed_ours_removed_theirs' ELSE 'changed_both_sides' END"


@query(f"""WITH base AS (SELECT p_partkey AS id, 'lib/' || p_partkey AS v FROM part WHERE p_partkey % 9 > 0), ours AS (SELECT p_partkey AS id, 'lib/' || CASE WHEN p_partkey % 4 = 0 THEN 'm' || p_partkey // 8 ELSE p_partkey::VARCHAR END AS v FROM part WHERE p_partkey % 7 > 0), theirs AS (SELECT p_partkey AS id, 'lib/' || CASE WHEN p_partkey % 6 = 0 THEN 'm' || p_partkey // 9 ELSE p_partkey::VARCHAR END AS v FROM part WHERE p_partkey % 5 > 0),
merged AS (SELECT id, {outcome_sql('o.v', 'a.v', 'b.v')} AS outcome, a.v AS av, b.v AS bv FROM base o FULL JOIN ours a USING (id) FULL JOIN theirs b USING (id)),
taken AS (SELECT id, outcome, CASE WHEN outcome = 'take_theirs' THEN bv WHEN outcome IN ('unchanged', 'same_change', 'take_ours') THEN av END AS v FROM merged), kept AS (SELECT id FROM taken WHERE v IS NOT NULL OR outcome LIKE '%both%' OR outcome LIKE '%removed%'),
lines AS (SELECT l_orderkey AS o, l_partkey AS p, min(l_linenumber) AS n FROM lineitem GROUP BY ALL), rb AS (FROM lines WHERE n <= 2 AND p % 9 > 0), ra AS (FROM rb WHERE p % 7 > 0), rt AS (FROM lines WHERE p % 5 > 0),
kept_r AS (SELECT o, p FROM lines LEFT JOIN rb b USING (o, p) LEFT JOIN ra a USING (o, p) LEFT JOIN rt t USING (o, p) WHERE CASE WHEN (b.n IS NULL) = (a.n IS NULL) THEN t.n IS NOT NULL ELSE a.n IS NOT NULL END)
SELECT outcome AS divergence, id::VARCHAR AS subject, NULL::VARCHAR AS other FROM taken WHERE outcome LIKE '%both%' OR outcome LIKE '%removed%'
UNION ALL SELECT 'path_collision', v, id::VARCHAR FROM taken WHERE v IN (SELECT v FROM taken WHERE v IS NOT NULL GROUP BY v HAVING count(*) > 1)
UNION ALL SELECT 'dangling_endpoint', 'o:' || o || '>p:' || p, 'p:' || p FROM kept_r WHERE p NOT IN (FROM kept)""", name="k12_merge_divergences")
def k12_merge_divergences(spark, d):
    """What a merge can't compose: values, paths that several artifacts claim, and relations into what neither side kept.

    Each side takes the relations of what it removes with it; the other side may still add one.
    """
    i = F.col("p_partkey")
    path = lambda c: F.concat(F.lit("lib/"), c)
    moved = lambda by, n: F.when(i % by == 0, F.concat(F.lit("m"), F.floor(i / n).cast("string"))).otherwise(i.cast("string"))
    rows = lambda gone, name: table(spark, d, "part").where(i % gone > 0).select(i.alias("id"), path(name).alias("value"))
    merged = cut(h.composed(rows(9, i.cast("string")), rows(7, moved(4, 8)), rows(5, moved(6, 9))))
    line = table(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("n"))
    node = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    line = line.select(F.concat_ws(">", node("o:", "l_orderkey"), node("p:", "l_partkey")).alias("id"), "l_orderkey", F.col("l_partkey").alias("value"), "n")
    old = line.where("n <= 2 and value % 9 > 0")
    relations = h.composed(old, old.where("value % 7 > 0"), line.where("value % 5 > 0")).where("survives")
    relations = relations.select("id", F.split("id", ">")[0].alias("src"), F.split("id", ">")[1].alias("dst"))
    nodes = merged.where("survives").select(node("p:", "id").alias("id")).unionByName(table(spark, d, "orders").select(node("o:", "o_orderkey").alias("id")))
    out = lambda df, name, subject, other: df.select(name.alias("divergence"), subject.cast("string").alias("subject"), other.cast("string").alias("other"))
    parts = out(merged.where(F.col("outcome").isin(*h.CONFLICTS)), F.col("outcome"), F.col("id"), F.lit(None))
    parts = parts.unionByName(out(h.path_collisions(merged.select("id", F.col("value").alias("path"))), F.lit("path_collision"), F.col("path"), F.col("id")))
    return parts.unionByName(out(h.dangling(relations, nodes), F.lit("dangling_endpoint"), F.col("id"), F.col("endpoint")))


APPROVALS = "approvals AS (SELECT event_id // 3 AS change, user_id AS actor, event_type = 'purchase' AS ok FROM events WHERE event_type IN ('purchase', 'view')), humans AS (SELECT DISTINCT user_id FROM events WHERE user_id % 3 = 1), waiting AS (SELECT root, node AS change, author FROM anc JOIN changes ON id = node WHERE parent IS NOT NULL AND node NOT IN (SELECT change FROM approvals WHERE ok AND actor IN (FROM humans)))"


def approvals_and_actors(spark, d):
    e = table(spark, d, "events")
    a = e.where("event_type in ('purchase', 'view')").select(F.floor(F.col("event_id") / 3).alias("change"), F.col("user_id").alias("actor"), F.when(F.col("event_type") == "purchase", "approved").otherwise("rejected").alias("decision"))
    actors = e.where("user_id % 3 < 2").select(F.col("user_id").alias("actor"), F.when(F.col("user_id") % 3 == 1, "Human").otherwise("Agent").alias("kind")).distinct()
    return a, actors


@query(f"WITH RECURSIVE {CHANGES_SQL}, {ANCESTRY}, {APPROVALS} SELECT root, change, author FROM waiting", name="c14_human_approvals")
def c14_human_approvals(spark, d):
    """Changes behind two heads that no human has approved; agents and unknown actors don't count."""
    c, heads = two_heads(spark, d)
    return rv.unapproved(g.ancestry(heads, c), c, *approvals_and_actors(spark, d))


@query(f"""WITH RECURSIVE {CHANGES_SQL}, {LOG_SQL}, {ANCESTRY}, {APPROVALS}, state AS (SELECT root, entity FROM (SELECT root, entity, op FROM entity_log JOIN heads ON ord <= node QUALIFY row_number() OVER (PARTITION BY root, entity ORDER BY ord DESC) = 1) WHERE op <> 'removed'),
empty AS (SELECT 'empty' AS branch), n AS (SELECT root AS branch, count(*) AS entities FROM state GROUP BY root UNION ALL SELECT branch, 0 FROM empty), w AS (SELECT root AS branch, count(*) AS waiting FROM waiting GROUP BY root)
SELECT branch, entities, 0::BIGINT AS covered, entities AS missing, CASE WHEN entities > 0 THEN 0.0::DOUBLE ELSE 1 END AS share, coalesce(waiting, 0) AS waiting, blockers, blockers = '' AS ok FROM (SELECT *, concat_ws(',', CASE WHEN entities > 0 THEN 'coverage' END, CASE WHEN entities > 0 THEN 'proof' END, CASE WHEN waiting > 0 THEN 'approval' END, CASE WHEN branch = 'right' THEN 'branch_moved' END) AS blockers FROM n LEFT JOIN w USING (branch))""", name="d6_k21_release_gate")
def k21_release_gate(spark, d):
    """Two branches, of which one has moved on, and one whose source is empty: entities at the source, their proof, and approvals."""
    c, heads = two_heads(spark, d)
    log = entity_log(spark, d).join(F.broadcast(heads), F.col("ord") <= F.col("node"))  # two rows
    state = log.groupBy(F.col("root").alias("branch"), F.col("entity").alias("id")).agg(F.max_by("op", "ord").alias("op")).where("op <> 'removed'").select("branch", "id")
    waiting = rv.unapproved(g.ancestry(heads, c), c, *approvals_and_actors(spark, d)).withColumnRenamed("root", "branch")
    branches = heads.select(F.col("root").alias("branch"), F.col("node").alias("source"), F.when(F.col("root") == "right", F.col("node") + 1).otherwise(F.col("node")).alias("head"), F.lit(None).cast("long").alias("expected"))
    branches = branches.unionByName(spark.createDataFrame([("empty", -1, -1, None)], branches.schema))
    return rv.release_check(branches, state, waiting, proof=True, approval=True)


# Graphs at two refs: 500 and 4,000 changes before the last one.
AT = lambda n, name: LOGS.replace("max(id) - 500", f"max(id) - {n}").replace("chain", f"chain{name}").replace("elog", f"elog{name}").replace("rlog", f"rlog{name}").replace("elast", f"elast{name}").replace("rlast", f"rlast{name}").replace("pruned", f"pruned{name}").replace("alive", f"alive{name}").replace("users AS", f"users{name} AS").replace(", users WHERE", f", users{name} WHERE")
IMPACT_AT = lambda name: f"""kept{name} AS (SELECT src, dst FROM rlast{name} WHERE op = 'added' AND id NOT IN (SELECT id FROM pruned{name}) AND src IN (FROM alive{name}) AND dst IN (FROM alive{name})),
cut{name} AS (SELECT r.src, r.dst FROM (SELECT id, change FROM rlast{name} WHERE op = 'removed' UNION ALL SELECT id, change FROM pruned{name}) t JOIN rlast{name} r USING (id) JOIN elast{name} e ON e.id = r.dst AND e.op = 'removed' AND e.change = t.change),
back{name}(a, b) AS (SELECT dst, src FROM kept{name} UNION SELECT dst, src FROM cut{name}), walk{name}(root, node, hop) AS (SELECT 'u:' || user_id, 'u:' || user_id, 0 FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 5 = 0) UNION SELECT root, b, hop + 1 FROM walk{name} JOIN back{name} ON a = node WHERE hop < 3)"""  # noqa: E731


@query(f"""WITH RECURSIVE {MAINLINE}, {LOG_SQL}, {AT(500, '1')}, {IMPACT_AT('1')}, {AT(700, '2')}, {IMPACT_AT('2')}
SELECT 'late' AS ref, root, node, min(hop)::INTEGER AS hop FROM walk1 WHERE node <> root AND node IN (FROM alive1) GROUP BY ALL UNION ALL SELECT 'early', root, node, min(hop)::INTEGER FROM walk2 WHERE node <> root AND node IN (FROM alive2) GROUP BY ALL""", name="k16_c12_impact_at_refs")
def k16_impact_at_refs(spark, d):
    """What every fifth user touches at two refs, over relations there and those that a removal severed."""
    c, out = mainline(spark, d), None
    log, rlog = entity_log(spark, d).select(F.col("ord").alias("change"), F.col("entity").alias("id"), "op"), relation_log(spark, d)
    starts = table(spark, d, "events").where("user_id % 5 = 0").select(F.concat(F.lit("u:"), F.col("user_id").cast("string")).alias("id")).distinct()
    for name, back in (("late", 500), ("early", 700)):
        alive, kept, dead = (cut(x) for x in h.resolve_at(h.first_parents(c, c.agg((F.max("id") - back).alias("id"))), log, rlog))
        ends = rlog.select("id", "src", "dst").distinct()
        gone = dead.where("part = 'entity'").select(F.col("id").alias("node"), F.col("change").alias("ended"))
        severed = h.severed(dead.where("part = 'relation'").select("id", F.col("change").alias("ended")).join(ends, "id").select("id", "src", "dst", "ended"), gone, ("dst",))
        got = g.impact_at(starts, alive, kept, severed, 3).withColumn("ref", F.lit(name))
        out = got if out is None else out.unionByName(got)
    return out.select("ref", "root", "node", "hop")


@query("SELECT o_orderkey AS review, CASE WHEN coalesce(blocking, 0) > 0 OR o_orderkey % 3 > 1 AND coalesce(attention, 0) > 2 THEN 'blocked' WHEN coalesce(attention, 0) > 0 OR o_orderkey % 3 > 0 THEN 'needs_attention' ELSE 'pass' END AS status, coalesce(blocking, 0) AS blocking, coalesce(attention, 0) AS attention FROM orders LEFT JOIN (SELECT l_orderkey, count(*) FILTER (l_discount > 0.08) AS blocking, count(*) FILTER (l_discount <= 0.08) AS attention FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey) ON l_orderkey = o_orderkey", name="d16_gate_decision")
def d16_gate_decision(spark, d):
    """Orders as reviews, returned lines as their findings."""
    reviews = table(spark, d, "orders").select(F.col("o_orderkey").alias("review"), (F.col("o_orderkey") % 3).alias("approvals"))
    findings = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("review"), (F.col("l_discount") > 0.08).alias("blocking"))
    return rv.decisions(reviews, findings)


@query("""WITH h AS (SELECT 'u:' || user_id AS entity, event_id AS change, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n, count(*) OVER (PARTITION BY user_id) AS changes FROM events),
pages AS (SELECT entity, changes, max(CASE WHEN n = 1 THEN change END) AS latest, coalesce(string_agg(change, ',' ORDER BY n) FILTER (n > 5 AND n <= 25), '') AS page FROM h GROUP BY ALL),
seen AS (SELECT event_id AS event, CASE WHEN event_id % 2 = 0 THEN 'u:' || user_id END AS entity, event_id // 2 AS change FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 512),
a AS (SELECT entity, least(count(DISTINCT event), 20) AS audit FROM (SELECT entity, event FROM seen WHERE entity IS NOT NULL UNION ALL SELECT h.entity, event FROM seen JOIN h USING (change) WHERE seen.entity IS NULL) GROUP BY entity),
ok AS (SELECT event_id // 3 AS latest, count(*) AS approvals FROM events WHERE event_type IN ('purchase', 'view') GROUP BY 1)
SELECT entity, changes, latest, page, CASE WHEN changes > 25 THEN 25 END::BIGINT AS next_offset, coalesce(approvals, 0) AS approvals, coalesce(audit, 0) AS audit FROM pages LEFT JOIN ok USING (latest) LEFT JOIN a USING (entity)""", name="k20_provenance")
def k20_provenance(spark, d):
    """Every user's second page of changes, approvals of the latest one, and audit events of the user or of a change."""
    e = table(spark, d, "events")
    user = F.concat(F.lit("u:"), F.col("user_id").cast("string"))
    history = e.select(user.alias("entity"), F.col("event_id").alias("change"), F.col("ts").alias("at"))
    audit = e.where("event_type = 'error'").select(F.col("event_id").alias("event"), F.when(F.col("event_id") % 2 == 0, user).alias("entity"), F.floor(F.col("event_id") / 2).alias("change"), F.col("ts").alias("at"))
    return rv.provenance(history, approvals_and_actors(spark, d)[0], audit, 5, 20)


@query("""WITH e AS (SELECT event_id % 500 AS review, * FROM events), off AS (SELECT DISTINCT review, user_id % 10 AS k FROM e WHERE event_type = 'error'),
assigned AS (SELECT review, count(DISTINCT user_id) AS reviewers FROM e WHERE event_type = 'click' AND (review, user_id % 10) NOT IN (SELECT (review, k) FROM off) GROUP BY review),
r AS (SELECT review, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS created, lower(max_by(CASE WHEN value > 30 THEN 'Approved' ELSE 'NeedsWork' END, (ts, event_id)) FILTER (event_type = 'purchase')) AS state, count(*) FILTER (event_type = 'purchase') AS decisions, count(*) FILTER (event_type = 'view') AS notes, count(*) FILTER (event_type = 'signup') AS discussions FROM e GROUP BY review)
SELECT review, created, state, decisions, notes, discussions, coalesce(reviewers, 0) AS reviewers FROM r LEFT JOIN assigned USING (review) WHERE state = 'needswork'""", name="b17_k26_review_list")
def k26_review_list(spark, d):
    """Reviews that need work, with what belongs to each and who reviews it now."""
    e = table(spark, d, "events").withColumn("review", F.col("event_id") % 500)
    of = lambda t: e.where(F.col("event_type") == t)
    decided = of("purchase").select("review", F.when(F.col("value") > 30, "Approved").otherwise("NeedsWork").alias("state"), F.col("ts").alias("at"), F.col("event_id").alias("id"))
    reviews = e.groupBy("review").agg(F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("created"))
    return rv.review_records(reviews, decided, of("view"), of("signup"), g6_current_assignments(spark, d), "needswork").select("review", "created", "state", "decisions", "notes", "discussions", "reviewers")

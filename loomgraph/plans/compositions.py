"""Queries over whole graphs at once: validated deltas, merges by field, reverts, typed traversals and context packs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import context, deltas, reverts
from ..operators import graph as g
from ..sources.store import cut, table
from .filters_and_joins import E
from .model import CHANGES_SQL, LOG_SQL, changes, entities, entity_log, relations
from .registry import query
from .traversal import OUT, RG, bfs

SCHEMA = {"customers": deltas.Table("id"), "orders": deltas.Table("id", strict=True, unique=("path",), refs={"customer": "customers"}), "notes": deltas.Table()}


def two_states(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    i = F.col("o_orderkey")
    o = table(spark, d, "orders").select(i.alias("id"), F.col("o_custkey").alias("customer"), F.concat(F.lit("o/"), i.cast("string")).alias("path"), F.lit(1).alias("version"))
    n = table(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("flag"), "l_orderkey")
    old = {"customers": c, "orders": o.where("id % 11 > 0"), "notes": n.where("l_orderkey % 3 = 0").drop("l_orderkey")}
    new = {"customers": c.withColumn("segment", F.when(F.col("id") % 6 == 0, "NEW").otherwise(F.col("segment"))), "orders": o.where("id % 12 > 0").withColumn("version", F.when(F.col("id") % 5 == 0, 2).otherwise(1)), "notes": n.where("l_orderkey % 4 = 0").drop("l_orderkey")}
    return old, new


@query("""WITH o AS (SELECT DISTINCT l_partkey AS part, l_returnflag AS flag FROM lineitem WHERE l_orderkey % 3 = 0), n AS (SELECT DISTINCT l_partkey AS part, l_returnflag AS flag FROM lineitem WHERE l_orderkey % 4 = 0),
od AS (SELECT o_orderkey AS id, o_custkey AS customer, CASE WHEN id % 11 = 0 AND id % 12 > 0 THEN 'added' WHEN id % 12 = 0 AND id % 11 > 0 THEN 'removed' WHEN id % 11 > 0 AND id % 12 > 0 AND id % 5 = 0 THEN 'modified' END AS op FROM orders),
bad AS (SELECT id, op FROM od WHERE op IS NOT NULL UNION ALL SELECT id, 'added' FROM od WHERE id % 97 = 0),
kept AS (SELECT id, customer FROM od WHERE id % 12 > 0 OR id % 97 = 0),
rows AS (SELECT 'delta' AS part, 'customers' AS name, 'modified' AS what, count(*) AS n FROM customer WHERE c_custkey % 6 = 0 AND c_mktsegment <> 'NEW' UNION ALL SELECT 'delta', 'orders', op, count(*) FROM od WHERE op IS NOT NULL GROUP BY op
  UNION ALL SELECT 'delta', 'notes', 'removed', count(*) FROM (FROM o EXCEPT FROM n) UNION ALL SELECT 'delta', 'notes', 'added', count(*) FROM (FROM n EXCEPT FROM o)
  UNION ALL SELECT 'after', 'customers', 'rows', count(*) FROM customer UNION ALL SELECT 'after', 'orders', 'rows', count(*) FROM orders WHERE o_orderkey % 12 > 0
  UNION ALL SELECT 'after', 'notes', 'rows', (SELECT count(*) FROM lineitem WHERE l_orderkey % 3 = 0 AND (l_partkey, l_returnflag) IN (SELECT (part, flag) FROM n)) + (SELECT count(*) FROM (FROM n EXCEPT FROM o))
  UNION ALL SELECT 'problem', 'orders', 'repeated', count(*) FROM (SELECT id FROM bad GROUP BY id HAVING count(*) > 1) UNION ALL SELECT 'problem', 'orders', 'not_unique', count(*) FROM (SELECT id FROM bad WHERE op <> 'removed' GROUP BY id HAVING count(*) > 1)
  UNION ALL SELECT 'problem', 'orders', 'added_present', count(DISTINCT id) FROM bad WHERE op = 'added' AND id % 11 > 0 UNION ALL SELECT 'problem', 'orders', 'dangling', count(DISTINCT customer) FROM kept WHERE customer % 50 = 0)
SELECT part, name AS "table", what, n FROM rows WHERE n > 0""", name="k8_k9_validated_delta")
def k8_validated_delta(spark, d):
    """The delta of all tables and what they hold after it; and what is wrong with another one that removes customers and adds orders that are there."""
    old, new = two_states(spark, d)
    delta = {name: cut(x) for name, x in deltas.graph_delta(old, new, SCHEMA).items()}
    then = deltas.applied(old, delta, SCHEMA)
    again = old["orders"].unionByName(new["orders"].where("id % 11 = 0")).where("id % 97 = 0")
    again = again.unionByName(table(spark, d, "orders").where("o_orderkey % 97 = 0 and o_orderkey % 11 = 0 and o_orderkey % 12 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"), F.concat(F.lit("o/"), F.col("o_orderkey").cast("string")).alias("path"), F.lit(1).alias("version")))
    bad = delta | {"orders": delta["orders"].unionByName(again.withColumn("op", F.lit("added"))), "customers": old["customers"].where("id % 50 = 0").withColumn("op", F.lit("removed"))}
    out = deltas.problems(old, bad, SCHEMA).groupBy("table", F.col("problem").alias("what")).agg(F.count("*").alias("n")).select(F.lit("problem").alias("part"), "table", "what", "n")
    for name in SCHEMA:
        out = out.unionByName(delta[name].groupBy("op").agg(F.count("*").alias("n")).select(F.lit("delta").alias("part"), F.lit(name).alias("table"), F.col("op").alias("what"), "n"))
        out = out.unionByName(then[name].agg(F.count("*").alias("n")).select(F.lit("after").alias("part"), F.lit(name).alias("table"), F.lit("rows").alias("what"), "n"))
    return out.where("n > 0")


FIELDS = ("visibility", "signature", "body")
SIDES = """o AS (SELECT id, visibility, signature, (line % 7)::VARCHAR AS body FROM entities WHERE line % 13 > 0),
a AS (SELECT id, visibility, CASE WHEN line % 6 = 0 THEN signature || '!' ELSE signature END AS signature, (CASE WHEN line % 10 = 0 THEN line ELSE line % 7 END)::VARCHAR AS body FROM entities WHERE line % 11 > 0),
b AS (SELECT id, CASE WHEN line % 9 = 0 THEN 'Private' ELSE visibility END AS visibility, CASE WHEN line % 15 = 0 THEN signature || '?' ELSE signature END AS signature, (CASE WHEN line % 20 = 0 THEN line WHEN line % 25 = 0 THEN line + 1 ELSE line % 7 END)::VARCHAR AS body FROM entities WHERE line % 12 > 0)"""
ROW = lambda t: "(" + ", ".join(f"{t}.{f}" for f in FIELDS) + ")"
CLASH = lambda f: f"CASE WHEN a.{f} IS DISTINCT FROM o.{f} AND b.{f} IS DISTINCT FROM o.{f} AND a.{f} IS DISTINCT FROM b.{f} THEN '{f}' END"
THREE = "o.id IS NOT NULL AND a.id IS NOT NULL AND b.id IS NOT NULL"


@query(E + f""", {SIDES}, m AS (SELECT id, CASE WHEN {THREE} THEN concat_ws(',', {', '.join(map(CLASH, FIELDS))}) ELSE '' END AS conflicts, {', '.join(f"CASE WHEN {THREE} THEN CASE WHEN a.{f} IS NOT DISTINCT FROM o.{f} THEN b.{f} WHEN b.{f} IS NOT DISTINCT FROM o.{f} OR a.{f} IS NOT DISTINCT FROM b.{f} THEN a.{f} ELSE o.{f} END ELSE coalesce(a.{f}, b.{f}) END AS {f}" for f in FIELDS)},
CASE WHEN {THREE} THEN CASE WHEN {ROW('a')} = {ROW('o')} AND {ROW('b')} = {ROW('o')} THEN 'untouched' WHEN {ROW('b')} = {ROW('o')} THEN 'ours' WHEN {ROW('a')} = {ROW('o')} THEN 'theirs' WHEN {ROW('a')} = {ROW('b')} THEN 'convergent' WHEN concat_ws(',', {', '.join(map(CLASH, FIELDS))}) <> '' THEN 'divergent' ELSE 'composed' END
 WHEN o.id IS NULL THEN CASE WHEN b.id IS NULL THEN 'ours' WHEN a.id IS NULL THEN 'theirs' WHEN {ROW('a')} = {ROW('b')} THEN 'convergent' ELSE 'add_add' END WHEN a.id IS NULL AND b.id IS NULL THEN 'gone' WHEN a.id IS NULL THEN CASE WHEN {ROW('b')} = {ROW('o')} THEN 'gone' ELSE 'modify_delete' END ELSE CASE WHEN {ROW('a')} = {ROW('o')} THEN 'gone' ELSE 'modify_delete' END END AS kind,
coalesce(a.signature <> b.signature, false) AS signature_change, CASE WHEN a.visibility <> b.visibility THEN a.visibility || '>' || b.visibility END AS visibility_change FROM o FULL JOIN a USING (id) FULL JOIN b USING (id))
SELECT id, visibility, signature, body, kind, conflicts, signature_change, visibility_change FROM m WHERE kind <> 'gone'""", name="k13_merge_by_fields")
def k13_merge_by_fields(spark, d):
    """Two sides that edit entities: different fields compose, one field in two ways doesn't."""
    e, line = entities(spark, d), F.col("line")
    rows = lambda skip, v, s, b: e.where(line % skip > 0).select("id", v.alias("visibility"), s.alias("signature"), b.cast("string").alias("body"))
    v, s = F.col("visibility"), F.col("signature")
    base = rows(13, v, s, line % 7)
    ours = rows(11, v, F.when(line % 6 == 0, F.concat(s, F.lit("!"))).otherwise(s), F.when(line % 10 == 0, line).otherwise(line % 7))
    theirs = rows(12, F.when(line % 9 == 0, "Private").otherwise(v), F.when(line % 15 == 0, F.concat(s, F.lit("?"))).otherwise(s), F.when(line % 20 == 0, line).when(line % 25 == 0, line + 1).otherwise(line % 7))
    return deltas.merge_fields(base, ours, theirs, "id", list(FIELDS))


TYPED = """typed AS (SELECT id, kind, 'entity' AS src_kind, src, 'entity' AS dst_kind, dst FROM relations UNION ALL SELECT 'Defines:' || id, 'Defines', 'artifact', file, 'entity', id FROM entities WHERE file IS NOT NULL UNION ALL SELECT 'Imports:' || s_suppkey, 'Imports', 'entity', 's:' || s_suppkey, 'external', 'crate/' || s_nationkey FROM supplier
  UNION ALL SELECT 'Covers:' || id, 'Covers', 'test', 't:' || id, 'entity', id FROM entities WHERE role = 'Test' UNION ALL SELECT 'Affects:' || o_orderkey, 'Affects', 'work', 'w' || o_orderkey, 'entity', 'o:' || o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'
  UNION ALL SELECT 'Governs:' || n_nationkey, 'ConsumesContract', 'contract', 'k' || n_regionkey, 'entity', 'n:' || n_nationkey FROM nation UNION ALL SELECT 'Annotates:' || c_custkey, 'Annotates', 'annotation', 'a' || c_custkey, 'entity', 'c:' || c_custkey FROM customer WHERE c_custkey % 10 = 0),
recorded AS (SELECT 'entity:' || id AS node FROM entities UNION SELECT 'artifact:' || file FROM entities WHERE file IS NOT NULL UNION SELECT 'external:crate/' || n_nationkey FROM nation WHERE n_nationkey % 2 = 0 UNION SELECT src_kind || ':' || src FROM typed WHERE src_kind IN ('test', 'contract', 'annotation') UNION SELECT 'work:w' || o_orderkey FROM orders WHERE o_orderkey % 2 = 0)"""
BOTH_TYPED = "SELECT src_kind || ':' || src, dst_kind || ':' || dst FROM typed UNION SELECT dst_kind || ':' || dst, src_kind || ':' || src FROM typed"


@query(RG + f", {TYPED}, {bfs('SELECT unnest([$$contract:k1$$, $$external:crate/3$$, $$work:w1$$]) AS id', BOTH_TYPED, 2)}, touched AS (SELECT DISTINCT root, hop < 2 AS expanded, t.id AS relation, node FROM reached JOIN typed t ON node IN (src_kind || ':' || src, dst_kind || ':' || dst) WHERE hop < 2) SELECT root, split_part(node, ':', 1) AS kind, substr(node, instr(node, ':') + 1) AS id, hop, node IN (FROM recorded) AS known, (SELECT count(DISTINCT relation) FROM touched x WHERE x.root = reached.root) AS relations FROM reached", name="i3_typed_traversal")
def i3_typed_traversal(spark, d):
    """What is around a contract, an external reference and a work item: nodes of all kinds, recorded or not, and how many relations were met."""
    e, lit, col = entities(spark, d), F.lit, F.col
    text = lambda prefix, c: F.concat(lit(prefix), col(c).cast("string"))

    def rows(df, prefix, key, kind, src_kind, src, dst_kind, dst):
        return df.select(text(prefix, key).alias("id"), lit(kind).alias("kind"), lit(src_kind).alias("src_kind"), src.alias("src"), lit(dst_kind).alias("dst_kind"), dst.alias("dst"))

    n, tests, urgent = table(spark, d, "nation"), e.where("role = 'Test'"), table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    notes, owned = table(spark, d, "customer").where("c_custkey % 10 = 0"), e.where("file is not null")
    typed = relations(spark, d).select("id", "kind", lit("entity").alias("src_kind"), "src", lit("entity").alias("dst_kind"), "dst")
    for more in (
        rows(owned, "Defines:", "id", "Defines", "artifact", col("file"), "entity", col("id")), rows(table(spark, d, "supplier"), "Imports:", "s_suppkey", "Imports", "entity", text("s:", "s_suppkey"), "external", text("crate/", "s_nationkey")),
        rows(tests, "Covers:", "id", "Covers", "test", text("t:", "id"), "entity", col("id")), rows(urgent, "Affects:", "o_orderkey", "Affects", "work", text("w", "o_orderkey"), "entity", text("o:", "o_orderkey")),
        rows(n, "Governs:", "n_nationkey", "ConsumesContract", "contract", text("k", "n_regionkey"), "entity", text("n:", "n_nationkey")), rows(notes, "Annotates:", "c_custkey", "Annotates", "annotation", text("a", "c_custkey"), "entity", text("c:", "c_custkey")),
    ):
        typed = typed.unionByName(more)
    node = lambda df, kind, key: df.select(lit(kind).alias("kind"), key.alias("id"))
    nodes = node(e, "entity", col("id")).unionByName(node(owned, "artifact", col("file"))).unionByName(node(n.where("n_nationkey % 2 = 0"), "external", text("crate/", "n_nationkey")))
    for kind, df, key in (("test", tests, text("t:", "id")), ("contract", n, text("k", "n_regionkey")), ("annotation", notes, text("a", "c_custkey")), ("work", table(spark, d, "orders").where("o_orderkey % 2 = 0"), text("w", "o_orderkey"))):
        nodes = nodes.unionByName(node(df, kind, key))
    starts = spark.createDataFrame([("contract", "k1"), ("external", "crate/3"), ("work", "w1")], "kind string, id string")
    found, touched = g.traverse(starts, typed, nodes, 2)
    return found.join(touched.groupBy("root").agg(F.count("*").alias("relations")), "root", "left").select("root", "kind", "id", "hop", "known", F.coalesce("relations", lit(0)).cast("long").alias("relations"))


REVIEWS = f"""{CHANGES_SQL}, {LOG_SQL}, kept AS (SELECT * FROM changes WHERE id % 83 <> 17), edits AS (SELECT ord AS change, entity, op, lag(value) OVER (PARTITION BY entity ORDER BY ord) AS old, value AS new FROM entity_log),
users AS (SELECT DISTINCT 'u:' || user_id AS entity, CASE WHEN user_id % 2 = 0 THEN 'Function' ELSE 'Class' END AS kind, 'n' || (user_id % 5) AS name, user_id % 3 > 0 AND user_id % 7 > 0 AS public FROM events),
reviews AS (SELECT event_id AS review, event_id AS base FROM events WHERE event_id % 40 = 39), span AS (SELECT review, n::INTEGER AS n, review + n AS change FROM reviews, range(1, 9) t(n)),
walk(review, change, hop, path) AS (SELECT review, base, 0, '' FROM reviews UNION SELECT w.review, u.up, hop + 1, path || slot FROM walk w JOIN (SELECT id, 0 AS slot, parent AS up FROM kept WHERE parent IS NOT NULL UNION ALL SELECT id, 1, merged FROM kept WHERE merged IS NOT NULL) u ON u.id = w.change),
win AS (SELECT review, change, min(hop) AS distance, min_by(path, (hop, path)) AS path, change IN (SELECT id FROM kept) AS known FROM walk GROUP BY ALL)"""


def reviews_of(spark, d):
    """Reviews of eight changes each, on bases whose histories lack some changes; (bases, changes, edits, ranges, entities)."""
    rows, user = changes(spark, d).where("id % 83 <> 17"), F.col("user_id")
    edits = entity_log(spark, d).select(F.col("ord").alias("change"), "entity", "op", F.lag("value").over(Window.partitionBy("entity").orderBy("ord")).alias("old"), F.col("value").alias("new"))
    e = table(spark, d, "events")
    bases = e.where("event_id % 40 = 39").select(F.col("event_id").alias("review"), F.col("event_id").alias("base"))
    ranges = bases.select("review", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("n")).withColumn("change", F.col("review") + F.col("n"))
    users = e.select(F.concat(F.lit("u:"), user.cast("string")).alias("id"), F.when(user % 2 == 0, "Function").otherwise("Class").alias("kind"), F.concat(F.lit("n"), (user % 5).cast("string")).alias("name"), F.when(user % 3 > 0, "Public").otherwise("Private").alias("visibility"), F.when(user % 7 > 0, "Source").otherwise("Test").alias("role")).distinct()
    return bases, rows, edits, ranges, users


@query(f"""WITH RECURSIVE {REVIEWS}, past AS (SELECT w.review, w.distance, w.path, e.* FROM win w JOIN edits e USING (change) WHERE known), head AS (SELECT s.review, s.n, e.* FROM span s JOIN edits e USING (change)),
changed AS (SELECT review, entity, min_by(old, n) FILTER (old IS NOT NULL) AS some, arg_min(coalesce(old, -999), n) AS old, arg_max(new, n) AS new FROM head WHERE op = 'modified' GROUP BY ALL HAVING arg_min(coalesce(old, -999), n) <> -999 AND arg_min(coalesce(old, -999), n) <> arg_max(new, n)),
restored AS (SELECT c.review, c.entity, arg_min(p.change, (p.distance, p.path)) AS undone, min(p.distance) AS distance FROM changed c JOIN past p ON p.review = c.review AND p.entity = c.entity AND p.op = 'modified' AND p.old = c.new GROUP BY ALL),
lasts AS (SELECT review, entity, arg_min(new, (distance, path)) AS body FROM past WHERE op <> 'removed' GROUP BY ALL), gone AS (SELECT p.review, p.entity, p.distance, p.path, body, kind, name FROM past p JOIN lasts USING (review, entity) JOIN users USING (entity) WHERE p.op = 'removed'),
added AS (SELECT review, kind, name, arg_min(entity, n) AS entity, arg_min(new, n) AS new, arg_min(public, n) AS public FROM head JOIN users USING (entity) WHERE op = 'added' GROUP BY ALL),
again AS (SELECT a.review, a.entity, a.public, (SELECT arg_min(distance, (distance, path)) FROM gone g WHERE g.review = a.review AND g.body = a.new) AS near, (SELECT arg_min(distance, (distance, path)) FROM gone g WHERE g.review = a.review AND g.kind = a.kind AND g.name = a.name) AS named FROM added a),
recent AS (SELECT review, entity, min(distance) AS distance FROM past WHERE op = 'added' GROUP BY ALL)
SELECT review, entity, 'restored_body' AS shape, distance, undone, count(*) OVER (PARTITION BY review, undone) > 1 AND public AND kind = 'Function' AS gates FROM restored JOIN users USING (entity)
UNION ALL SELECT review, entity, CASE WHEN near IS NOT NULL THEN 'reintroduced' ELSE 'same_name' END, coalesce(near, named), NULL, near IS NOT NULL AND public FROM again WHERE near IS NOT NULL OR named IS NOT NULL
UNION ALL SELECT DISTINCT h.review, h.entity, 'recent_removal', r.distance, NULL, false FROM head h JOIN recent r USING (review, entity) WHERE op = 'removed'""", name="k14_revert_findings")
def k14_revert_findings(spark, d):
    bases, rows, edits, ranges, users = reviews_of(spark, d)
    return reverts.revert_findings(reverts.base_windows(bases, rows), edits, ranges, users)


@query(f"""WITH RECURSIVE {REVIEWS} SELECT review, 'incomplete_ancestry' AS gap, count(*) AS n, arg_min(change, (distance, path)) AS first, arg_min(distance, (distance, path)) AS distance FROM win WHERE NOT known GROUP BY review
UNION ALL SELECT review, 'shallow', count(*) FILTER (known), NULL, NULL FROM win GROUP BY review HAVING count(*) FILTER (known) < 25""", name="k14_evidence_gaps")
def k14_evidence_gaps(spark, d):
    bases, rows, *_ = reviews_of(spark, d)
    return reverts.evidence_gaps(reverts.base_windows(bases, rows))


COST = "len(regexp_extract_all(coalesce({0}, ''), '([a-zA-Z0-9_]+|[^a-zA-Z0-9_\\s])', 1))"
FOCAL = "SELECT id FROM entities WHERE kind = 'Method' AND line = 5 OR id IN ('p:7', 'c:5')"


@query(RG + f""", {bfs(FOCAL, OUT, 2)}, told AS (SELECT e.*, d.text AS body FROM entities e LEFT JOIN documents d ON e.id = 'p:' || d.doc_id),
extras AS (SELECT 'contract' AS section, 'k:' || c_custkey AS id, 'c:' || c_custkey AS about, 'contract of ' || c_mktsegment AS text FROM customer UNION ALL SELECT 'test', 't:' || l_orderkey || ':' || l_linenumber, 'o:' || l_orderkey, 'checks part ' || l_partkey FROM lineitem WHERE l_returnflag = 'R'
  UNION ALL SELECT 'work', 'w:' || o_orderkey, 'o:' || o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'note', 'n:' || conv_id || ':' || turn, 'p:' || conv_id, text FROM conversations UNION ALL SELECT 'traffic', 'i:' || event_id, 'p:' || user_id, 'session of ' || event_type FROM events WHERE event_id % 3 = 0),
near AS (SELECT root, node AS about, hop FROM reached WHERE hop < 2), rows AS (SELECT root, CASE hop WHEN 0 THEN 'focal' WHEN 1 THEN 'dependency_signature' ELSE 'transitive' END AS section, id, hop, CASE hop WHEN 0 THEN coalesce(body, signature) WHEN 1 THEN signature ELSE kind || ' ' || name END AS text FROM reached JOIN told ON id = node
  UNION ALL SELECT root, section, id, min(hop), min(text) FROM extras JOIN near USING (about) GROUP BY root, section, id),
cost AS (SELECT root, section, id, hop, list_position({list(context.SECTIONS)}, section) AS o, greatest({COST.format('text')} + {COST.format('text')} // 7, 1)::BIGINT AS tokens FROM rows), run AS (SELECT *, sum(tokens) OVER (PARTITION BY root ORDER BY o, hop, id ROWS UNBOUNDED PRECEDING)::BIGINT AS total FROM cost)
SELECT root, section, id, tokens, total FROM run WHERE total <= 500""", name="i15_context_sections")
def i15_context_sections(spark, d):
    """Packs of many focal entities in one plan: bodies, signatures, names, contracts, tests, work, notes and traffic within 500 tokens each."""
    e, text = entities(spark, d), lambda prefix, *c: F.concat(F.lit(prefix), F.concat_ws(":", *[F.col(x).cast("string") for x in c]))
    told = e.join(table(spark, d, "documents").select(text("p:", "doc_id").alias("id"), F.col("text").alias("body")), "id", "left")
    extra = lambda df, section, key, about, says: df.select(F.lit(section).alias("section"), key.alias("id"), about.alias("about"), says.alias("text"))
    extras = extra(table(spark, d, "customer"), "contract", text("k:", "c_custkey"), text("c:", "c_custkey"), text("contract of ", "c_mktsegment"))
    for more in (
        extra(table(spark, d, "lineitem").where("l_returnflag = 'R'"), "test", text("t:", "l_orderkey", "l_linenumber"), text("o:", "l_orderkey"), text("checks part ", "l_partkey")),
        extra(table(spark, d, "orders").where("o_orderstatus = 'O'"), "work", text("w:", "o_orderkey"), text("o:", "o_orderkey"), F.col("o_orderpriority")),
        extra(table(spark, d, "conversations"), "note", text("n:", "conv_id", "turn"), text("p:", "conv_id"), F.col("text")), extra(table(spark, d, "events").where("event_id % 3 = 0"), "traffic", text("i:", "event_id"), text("p:", "user_id"), text("session of ", "event_type")),
    ):
        extras = extras.unionByName(more)
    focal = e.where("kind = 'Method' and line = 5 or id in ('p:7', 'c:5')").select("id")
    return context.context_pack(focal, told, relations(spark, d), extras, 500)

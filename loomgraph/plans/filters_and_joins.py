"""Queries B, C and G: filters, joins and set operations over the graph tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import filters as fl
from ..operators import graph as g
from ..operators import history as h
from ..operators.filters import tokens
from ..sources.store import table
from .model import CHANGES_SQL, ENTITIES_SQL, GRAPH_SQL, LOG_SQL, changes, entities, entity_log, relations
from .registry import query

E, G = f"WITH {ENTITIES_SQL}\n", f"WITH {GRAPH_SQL}\n"
LEX = "CASE WHEN instr(lower(name), 'red') > 0 THEN 'name' WHEN instr(lower(signature), 'red') > 0 THEN 'signature' WHEN kind NOT IN ('Package', 'Module') AND instr(lower(file), 'red') > 0 THEN 'file' WHEN kind NOT IN ('Package', 'Module') AND instr(lower(language), 'red') > 0 THEN 'language' WHEN kind NOT IN ('Package', 'Module') AND instr(lower(role), 'red') > 0 THEN 'role' END"
TOKENS = "list_filter(string_split_regex(lower(regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda t: t <> '')"
IMPACT = "(" + ", ".join(f"'{k}'" for k in fl.IMPACT_KINDS) + ")"
INBOUND = f"inbound AS (SELECT r.* FROM relations r WHERE kind IN {IMPACT} AND (kind = 'Calls' OR NOT EXISTS (SELECT 1 FROM relations c WHERE c.kind = 'Contains' AND c.src = r.src AND c.dst = r.dst)))"
NONPRODUCTION = r"coalesce(regexp_matches(replace(lower(file), '\', '/'), '" + fl.NONPRODUCTION + "'), false)"
CANDIDATE = f"kind IN ({', '.join(repr(k) for k in fl.CODE_KINDS)}) AND NOT {NONPRODUCTION} AND NOT (kind = 'Method' AND regexp_matches(name, '(^|\\.)__[^.]*__$'))"


@query(E + "SELECT id, kind, name, file FROM entities WHERE kind IN ('Class', 'Interface') AND role = 'Source' AND language IN ('Python', 'Rust') AND ends_with(lower(name), '7')")
def b1_query_entities(spark, d):
    return fl.select_entities(entities(spark, d), ["Class", "Interface"], ["Source"], ["Python", "Rust"], name="*7").select("id", "kind", "name", "file")


@query(E + "SELECT p, id, name FROM entities, (VALUES ('*9', 1), ('red*', 2), ('WIDGET_1', 3)) AS v(p, k) WHERE CASE k WHEN 1 THEN ends_with(lower(name), '9') WHEN 2 THEN starts_with(lower(name), 'red') ELSE contains(lower(name), 'widget_1') END")
def b2_name_matches(spark, d):
    rows = entities(spark, d)
    out = [rows.where(fl.name_matches(F.col("name"), p)).select(F.lit(p).alias("p"), "id", "name") for p in ("*9", "red*", "WIDGET_1")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(E + f""", hit AS (SELECT id, name, lower(name) = 'nation_1' AS exact, list_has_all({TOKENS.format('name')}, ['nation', '1']) AS word, contains(lower(name), 'nation_1') AS part FROM entities)
SELECT id, name, CASE WHEN exact THEN 1 ELSE 2 END AS tier FROM hit WHERE exact OR (word AND (SELECT count(*) FROM hit WHERE word AND NOT exact) <= 32)
UNION ALL SELECT id, name, 3 FROM hit WHERE part AND NOT EXISTS (SELECT 1 FROM hit WHERE exact OR (word AND (SELECT count(*) FROM hit WHERE word AND NOT exact) <= 32))""")
def b3_name_tiers(spark, d):
    return fl.by_name_tiers(entities(spark, d), "nation_1").select("id", "name", "tier")


@query(E + "SELECT id, kind, line FROM entities WHERE file = 'src/n3/customers.py' UNION ALL SELECT id, kind, line FROM entities WHERE kind = 'Interface'")
def b4_by_file_or_kind(spark, d):
    e = entities(spark, d)
    return fl.select_entities(e, file="src/n3/customers.py").unionByName(fl.select_entities(e, ["Interface"])).select("id", "kind", "line")


@query(E + f"SELECT id, name FROM entities WHERE list_has_all({TOKENS.format('name')}, ['blue', 'bolt'])")
def b5_all_tokens(spark, d):
    return fl.by_all_tokens(entities(spark, d), "blueBolt").select("id", "name")


@query(E + "SELECT id, name, (SELECT count(*) FROM entities WHERE kind = 'Class') AS total, CASE WHEN (SELECT count(*) FROM entities WHERE kind = 'Class') > 75 THEN 75 END::BIGINT AS next_offset FROM entities WHERE kind = 'Class' ORDER BY name, id LIMIT 25 OFFSET 50")
def b6_page(spark, d):
    return fl.page(fl.select_entities(entities(spark, d), ["Class"]).select("id", "name"), ["name", "id"], 25, 50)


@query(E + f"""SELECT id, field, substr(t, greatest(pos - 8, 1), least(pos - 1, 8) + 11) AS excerpt FROM (
SELECT id, field, t, instr(lower(t), 'red') AS pos FROM (SELECT id, {LEX} AS field, CASE {LEX} WHEN 'name' THEN name WHEN 'signature' THEN signature WHEN 'file' THEN file WHEN 'language' THEN language WHEN 'role' THEN role END AS t FROM entities) WHERE field IS NOT NULL) ORDER BY id LIMIT 20""")
def b7_b8_lexical_lookup(spark, d):
    return fl.lexical_lookup(entities(spark, d), "RED", 20, 8)


@query(G + f", {INBOUND} SELECT kind, count(*) AS n, sum(evidence)::BIGINT AS evidence FROM inbound GROUP BY kind")
def b9_b10_impact_relations(spark, d):
    return fl.impact_relations(relations(spark, d)).groupBy("kind").agg(F.count("*").alias("n"), F.sum("evidence").alias("evidence"))


@query(E + f"SELECT id, kind, file FROM entities WHERE {CANDIDATE}")
def b11_dead_code_candidates(spark, d):
    return fl.dead_code_candidates(entities(spark, d)).select("id", "kind", "file")


@query(E + "SELECT id, kind, signature FROM entities WHERE visibility = 'Public' AND role = 'Source' AND kind NOT IN ('File', 'DocumentNode', 'Test')")
def b12_api_surface(spark, d):
    return fl.api_surface(entities(spark, d)).select("id", "kind", "signature")


@query(G + """SELECT kind, CASE WHEN origin = 'Lsp' THEN 'language_server' WHEN origin = 'Manual' THEN 'manual' WHEN confidence = 1 THEN 'exact' WHEN confidence = 0.95 THEN 'type_inferred' WHEN confidence = 0.9 THEN 'import_scoped' WHEN confidence = 0.8 THEN 'receiver_guess' WHEN confidence = 0.5 THEN 'name_only' WHEN confidence = 0.3 THEN 'derived'
WHEN confidence >= 0.95 THEN 'type_inferred' WHEN confidence >= 0.8 THEN 'receiver_guess' ELSE 'name_only' END AS tier, count(*) AS n FROM (SELECT kind, origin, round(confidence, 2) AS confidence FROM relations) GROUP BY ALL""")
def b13_resolution_tier(spark, d):
    return relations(spark, d).groupBy("kind", fl.resolution(F.col("origin"), F.col("confidence")).alias("tier")).agg(F.count("*").alias("n"))


@query(E + "SELECT id, kind, file FROM entities WHERE lower(replace(kind, '_', '')) IN ('class', 'function') AND starts_with(file, 'src/n1')")
def b14_export_filter(spark, d):
    return entities(spark, d).where(F.regexp_replace(F.lower("kind"), "_", "").isin("class", "function") & F.col("file").startswith("src/n1")).select("id", "kind", "file")


@query("SELECT o_orderkey AS work, o_orderpriority AS priority, o_orderstatus AS status FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'O' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def b15_work_filter(spark, d):
    scopes = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").where("o_orderpriority in ('1-URGENT', '2-HIGH') and o_orderstatus = 'O'").join(scopes, "o_orderkey", "left_semi").select(F.col("o_orderkey").alias("work"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))


@query("SELECT DISTINCT l_partkey AS target, l_returnflag AS staleness FROM lineitem WHERE l_returnflag <> 'A'")
def b16_annotation_filter(spark, d):
    return table(spark, d, "lineitem").where("l_returnflag <> 'A'").select(F.col("l_partkey").alias("target"), F.col("l_returnflag").alias("staleness")).dropDuplicates()


@query("SELECT event_id AS id, 'u' || user_id AS actor, event_type AS action, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp FROM events WHERE starts_with('u' || user_id, 'u1') AND contains(event_type, 'i') AND strftime(ts, '%Y-%m-%d %H:%M:%S') >= '2024-01-10' ORDER BY stamp DESC, id DESC LIMIT 50")
def b18_audit_filter(spark, d):
    log = table(spark, d, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("actor"), F.col("event_type").alias("action"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))
    return fl.audit(log, "u1*", "i", "2024-01-10", 50).withColumnRenamed("at", "stamp")


@query("""WITH i AS (SELECT o_orderkey AS intent, o_custkey AS session, l_suppkey AS scope, CASE WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE 1 END AS rank FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' GROUP BY ALL)
SELECT a.intent, CASE WHEN max(b.rank) = 2 THEN 'blocked' ELSE 'warned' END AS outcome, count(*) AS others FROM i a JOIN i b ON a.scope = b.scope AND a.session <> b.session GROUP BY a.intent""")
def b19_intent_collisions(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'P'")
    i = o.join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("intent"), F.col("o_custkey").alias("session"), F.col("l_suppkey").alias("scope"), F.when(F.col("o_orderpriority") == "1-URGENT", "hard").otherwise("soft").alias("lock")).distinct()
    return fl.collisions(i)


@query(E + "SELECT e.id, e.file FROM entities e WHERE EXISTS (SELECT 1 FROM entities n WHERE n.kind = 'Module' AND starts_with(e.file, 'src/n' || n.id[3:] || '/') AND n.line % 6 = 0)")
def b20_entry_points(spark, d):
    e = entities(spark, d)
    declared = e.where("kind = 'Module' and line % 6 = 0").select(F.concat(F.lit("src/n"), F.substring("id", 3, 20)).alias("module"))
    return e.where("file is not null").withColumn("module", F.substring_index("file", "/", 2)).where("file like 'src/n%/%'").join(declared, "module", "left_semi").select("id", "file")


@query(E + "SELECT id, (len(file) - len(replace(file, '/', '')) + 1)::INTEGER AS depth, file[:7] = 'src/n4/' AS within FROM entities WHERE starts_with(file, 'src/')")
def b21_scope_within(spark, d):
    scope = F.split("file", "/")
    return entities(spark, d).where("file like 'src/%'").select("id", F.size(scope).alias("depth"), fl.scope_within(scope, F.array(F.lit("src"), F.lit("n4"))).alias("within"))


@query(G + """, derived AS (SELECT id FROM entities WHERE role = 'Generated'), c AS (SELECT kind, CASE WHEN src IN (FROM derived) OR dst IN (FROM derived) THEN least(confidence, 0.3) ELSE confidence END AS confidence, CASE WHEN src IN (FROM derived) OR dst IN (FROM derived) THEN 'Inferred' ELSE origin END AS origin FROM relations)
SELECT kind, origin, count(*) AS n, round(sum(confidence), 4) AS confidence FROM c GROUP BY ALL""")
def b22_capped_confidence(spark, d):
    derived = entities(spark, d).where("role = 'Generated'").select("id")
    return fl.capped_confidence(relations(spark, d), derived).groupBy("kind", "origin").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 4).alias("confidence"))


@query(G + "SELECT e.id, r.id AS relation, r.dst FROM entities e JOIN relations r ON r.src = e.id JOIN entities t ON t.id = r.dst WHERE e.kind = 'Class' AND r.kind IN ('Imports')")
def c1_outgoing(spark, d):
    e = entities(spark, d)
    r = relations(spark, d).where("kind = 'Imports'").select(F.col("id").alias("relation"), "src", "dst")
    return e.where("kind = 'Class'").join(r, F.col("id") == F.col("src")).join(e.select(F.col("id").alias("dst")), "dst", "left_semi").select("id", "relation", "dst")


@query(G + "SELECT n.id, count(*) AS touching FROM entities n JOIN relations r ON r.src = n.id OR r.dst = n.id WHERE n.kind = 'Module' GROUP BY n.id")
def c2_touching(spark, d):
    n, r = entities(spark, d).where("kind = 'Module'").select("id"), relations(spark, d)
    both = r.select(F.col("src").alias("node"), "id").unionByName(r.where("src <> dst").select(F.col("dst").alias("node"), "id"))
    return n.join(both.select("node"), n.id == F.col("node")).groupBy(n.id).agg(F.count("*").alias("touching"))


CROSS = "cross_file AS (SELECT DISTINCT r.dst AS id FROM relations r JOIN entities a ON a.id = r.src JOIN entities b ON b.id = r.dst WHERE a.file IS DISTINCT FROM b.file {0})"


@query(G + ", " + CROSS.format("") + f" SELECT id, kind, name FROM entities WHERE {CANDIDATE} AND id NOT IN (FROM cross_file)")
def c3_dead_code(spark, d):
    e = entities(spark, d)
    return g.dead_code(fl.dead_code_candidates(e), e, relations(spark, d)).select("id", "kind", "name")


@query(G + ", " + CROSS.format("AND r.kind IN ('Calls', 'References')") + " SELECT e.kind, count(*) AS n FROM entities e JOIN cross_file USING (id) GROUP BY e.kind")
def c4_incoming_of_kinds(spark, d):
    e = entities(spark, d)
    return e.join(g.cross_file_targets(e, relations(spark, d), ["Calls", "References"]), "id", "left_semi").groupBy("kind").agg(F.count("*").alias("n"))


@query("""WITH imports AS (SELECT o_orderkey AS src, CASE WHEN o_orderkey % 2 = 0 THEN 'r' || (o_custkey % 25) END AS named, CASE WHEN o_orderkey % 4 = 1 THEN 'r' || (o_custkey % 25) || '/x' END AS source, 'P' || o_custkey AS name FROM orders),
defs AS (SELECT p_partkey AS entity, 'r' || (p_partkey % 25) AS repo, 'P' || (p_partkey // 3) AS name FROM part),
hits AS (SELECT src, named, source, repo, entity FROM imports i JOIN defs d USING (name)),
within AS (SELECT * FROM hits WHERE named IS NULL AND starts_with(source, repo || '/')),
rest AS (SELECT *, count(*) OVER (PARTITION BY src) AS n FROM hits WHERE named IS NULL AND src NOT IN (SELECT src FROM within))
SELECT src, repo, entity, 0.95::DOUBLE AS confidence FROM hits WHERE named = repo UNION ALL SELECT src, repo, entity, 0.8 FROM within UNION ALL SELECT src, repo, entity, CASE WHEN n = 1 THEN 0.9 ELSE 0.5 END FROM rest""")
def c5_import_resolution(spark, d):
    """An import that names its repository resolves there or not at all; one whose source lies in a repository, there; others by name, surer if there is one hit."""
    c, repo = F.col, lambda n: F.concat(F.lit("r"), (F.col(n) % 25).cast("string"))
    i = table(spark, d, "orders").select(c("o_orderkey").alias("src"), F.when(c("o_orderkey") % 2 == 0, repo("o_custkey")).alias("named"), F.when(c("o_orderkey") % 4 == 1, F.concat(repo("o_custkey"), F.lit("/x"))).alias("source"), F.concat(F.lit("P"), c("o_custkey").cast("string")).alias("name"))
    t = table(spark, d, "part").select(c("p_partkey").alias("entity"), repo("p_partkey").alias("repo"), F.concat(F.lit("P"), F.floor(c("p_partkey") / 3).cast("string")).alias("name"))
    inside = F.coalesce(c("named").isNull() & c("source").startswith(F.concat("repo", F.lit("/"))), F.lit(False))
    hits = i.join(t, "name").withColumn("inside", inside)
    n = hits.groupBy("src").agg(F.count("*").alias("n"), F.max("inside").alias("any"))
    hits = hits.join(n, "src")
    confidence = F.when(c("named") == c("repo"), 0.95).when(c("inside"), 0.8).when(c("named").isNull() & ~c("any"), F.when(c("n") == 1, 0.9).otherwise(0.5))
    return hits.select("src", "repo", "entity", confidence.alias("confidence")).where("confidence is not null")


@query(G + "SELECT r.id, r.src, r.dst FROM relations r LEFT JOIN entities e ON e.id = r.dst AND e.role <> 'Test' WHERE r.kind IN ('Calls', 'References') AND r.evidence > 1 AND e.id IS NULL")
def c6_unresolved_imports(spark, d):
    local = entities(spark, d).where("role <> 'Test'").select(F.col("id").alias("dst"))
    return relations(spark, d).where("kind in ('Calls', 'References') and evidence > 1").join(local, "dst", "left_anti").select("id", "src", "dst")


@query("""WITH need AS (SELECT s_suppkey AS interface, s_suppkey * 7 + k * 13 AS member FROM supplier, (VALUES (0), (1)) v(k) WHERE k <= s_suppkey % 2),
offer AS (SELECT DISTINCT l_orderkey AS class, l_partkey AS member FROM lineitem)
SELECT interface, class, count(*) AS members FROM need JOIN offer USING (member) GROUP BY interface, class HAVING count(*) = (SELECT count(*) FROM need n WHERE n.interface = need.interface)""")
def c7_interface_satisfaction(spark, d):
    """Relational division: classes that offer every member an interface needs."""
    k = F.filter(F.array(F.lit(0), F.lit(1)), lambda k: k <= F.col("s_suppkey") % 2)
    need = table(spark, d, "supplier").select(F.col("s_suppkey").alias("interface"), F.explode(F.transform(k, lambda k: F.col("s_suppkey") * 7 + k * 13)).alias("member"))
    offer = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("class"), F.col("l_partkey").alias("member")).distinct()
    n = need.groupBy("interface").agg(F.count("*").alias("n"))
    return need.join(offer, "member").groupBy("interface", "class").agg(F.count("*").alias("members")).join(n, "interface").where("members = n").select("interface", "class", "members")


@query("""WITH need AS (SELECT s_suppkey AS interface, s_suppkey * 7 + k * 13 AS member FROM supplier, (VALUES (0), (1)) v(k) WHERE k <= s_suppkey % 2),
offer AS (SELECT DISTINCT l_orderkey AS class, l_partkey AS member FROM lineitem),
ok AS (SELECT interface, class FROM need JOIN offer USING (member) GROUP BY interface, class HAVING count(*) = (SELECT count(*) FROM need n WHERE n.interface = need.interface))
SELECT interface, o_custkey AS caller, count(*) AS classes FROM ok JOIN orders ON o_orderkey = class GROUP BY ALL""")
def i20_dispatch_callers(spark, d):
    """Who calls a class through an interface that it satisfies."""
    calls = table(spark, d, "orders").select(F.col("o_orderkey").alias("class"), F.col("o_custkey").alias("caller"))
    return c7_interface_satisfaction(spark, d).join(calls, "class").groupBy("interface", "caller").agg(F.count("*").alias("classes"))


@query(G + """, ext AS (SELECT id, name FROM entities WHERE role = 'Test'), proof AS (SELECT 'p:' || l_partkey AS id, min(l_orderkey) AS context FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40 GROUP BY 1)
SELECT r.id, r.src AS entity, r.dst AS target, ext.name, proof.context FROM relations r JOIN ext ON ext.id = r.dst LEFT JOIN proof ON proof.id = r.dst WHERE r.kind = 'Calls'""")
def c18_external_edges(spark, d):
    """Relations into symbols owned elsewhere, with what is known of the symbol and its proof; what is unknown stays null."""
    ext = entities(spark, d).where("role = 'Test'").select(F.col("id").alias("target"), "name")
    proof = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 40").groupBy(F.concat(F.lit("p:"), F.col("l_partkey").cast("string")).alias("target")).agg(F.min("l_orderkey").alias("context"))
    r = relations(spark, d).where("kind = 'Calls'").select("id", F.col("src").alias("entity"), F.col("dst").alias("target"))
    return r.join(ext, "target").join(proof, "target", "left").select("id", "entity", "target", "name", "context")


OLD_NEW = "old AS (SELECT id, visibility, signature, line % 7 AS body FROM entities WHERE line % 11 > 0), new AS (SELECT id, CASE WHEN line % 13 = 0 THEN 'Private' ELSE visibility END AS visibility, CASE WHEN line % 17 = 0 THEN signature || '?' ELSE signature END AS signature, CASE WHEN line % 5 = 0 THEN line ELSE line % 7 END AS body FROM entities WHERE line % 12 > 0)"


def old_new(spark, d):
    e = entities(spark, d)
    old = e.where("line % 11 > 0").select("id", "visibility", "signature", (F.col("line") % 7).alias("body"))
    new = e.where("line % 12 > 0").select("id", F.when(F.col("line") % 13 == 0, "Private").otherwise(F.col("visibility")).alias("visibility"), F.when(F.col("line") % 17 == 0, F.concat("signature", F.lit("?"))).otherwise(F.col("signature")).alias("signature"), F.when(F.col("line") % 5 == 0, F.col("line")).otherwise(F.col("line") % 7).alias("body"))
    return old, new


@query(E + f", {OLD_NEW} SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' ELSE 'modified' END AS change FROM old o FULL JOIN new n ON o.id = n.id WHERE o.id IS NULL OR n.id IS NULL OR o.visibility <> n.visibility OR o.signature <> n.signature OR o.body <> n.body")
def c8_snapshot_diff(spark, d):
    return h.diff(*old_new(spark, d), "id", ["visibility", "signature", "body"]).select("id", "change")


@query("WITH o AS (SELECT DISTINCT l_partkey AS part, l_returnflag AS flag FROM lineitem WHERE l_orderkey % 3 = 0), n AS (SELECT DISTINCT l_partkey AS part, l_returnflag AS flag FROM lineitem WHERE l_orderkey % 4 = 0) (SELECT *, 'removed' AS side FROM (FROM o EXCEPT FROM n)) UNION ALL (SELECT *, 'added' FROM (FROM n EXCEPT FROM o))")
def c9_bag_diff(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("flag"))
    return h.bag_diff(rows.where("l_orderkey % 3 = 0").drop("l_orderkey"), rows.where("l_orderkey % 4 = 0").drop("l_orderkey"))


TREES = "t AS (SELECT file AS path, count(*) AS entries, sum(size)::BIGINT AS size FROM entities WHERE file IS NOT NULL GROUP BY file), old AS (FROM t WHERE entries % 5 > 0), new AS (SELECT path, entries, CASE WHEN size % 3 = 0 THEN size + 1 ELSE size END AS size FROM t WHERE size % 7 > 0)"


def trees(spark, d):
    t = entities(spark, d).where("file is not null").groupBy(F.col("file").alias("path")).agg(F.count("*").alias("entries"), F.sum("size").alias("size"))
    return t.where("entries % 5 > 0"), t.where("size % 7 > 0").withColumn("size", F.when(F.col("size") % 3 == 0, F.col("size") + 1).otherwise(F.col("size")))


@query(E + f", {TREES} SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'modified' END AS change FROM old o FULL JOIN new n ON o.path = n.path WHERE o.path IS NULL OR n.path IS NULL OR o.size <> n.size", name="c10_k17_k18_tree_diff")
def c10_tree_diff(spark, d):
    return h.diff(*trees(spark, d), "path", ["size"]).select("path", "change")


REVISIONS = "revisions AS (SELECT entity, ord AS introduced, ended, value FROM (SELECT *, lead(ord) OVER (PARTITION BY entity ORDER BY ord) AS ended FROM entity_log) WHERE op <> 'removed')"


@query(f"WITH {LOG_SQL}, {REVISIONS} SELECT entity, introduced, ended, value FROM revisions WHERE introduced <= 700 AND (ended IS NULL OR ended > 700)")
def c11_as_of(spark, d):
    return h.active_at(h.revisions(entity_log(spark, d)), 700)


@query(f"WITH {LOG_SQL}, gone AS (SELECT entity AS node, ord AS ended FROM entity_log WHERE op = 'removed'), x AS (SELECT ord AS id, entity AS src, 'u:' || (ord % 90) AS dst, CASE WHEN op = 'removed' THEN ord WHEN ord % 4 = 0 THEN ord + 1 END AS ended FROM entity_log) SELECT DISTINCT id, src, dst, ended FROM x WHERE EXISTS (SELECT 1 FROM gone WHERE gone.ended = x.ended AND gone.node IN (x.src, x.dst))")
def c12_severed_edges(spark, d):
    log = entity_log(spark, d)
    edges = log.select(F.col("ord").alias("id"), F.col("entity").alias("src"), F.concat(F.lit("u:"), (F.col("ord") % 90).cast("string")).alias("dst"), F.when(F.col("op") == "removed", F.col("ord")).when(F.col("ord") % 4 == 0, F.col("ord") + 1).alias("ended"))
    return h.severed(edges, log.where("op = 'removed'").select(F.col("entity").alias("node"), F.col("ord").alias("ended")))


REVERSIONS = """rows AS (SELECT *, row_number() OVER w AS n, lag(value) OVER w AS before FROM entity_log WHERE op <> 'removed' WINDOW w AS (PARTITION BY entity ORDER BY ord)),
seen AS (SELECT *, max(n) OVER (PARTITION BY entity, value ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM rows),
reverted AS (SELECT entity, ord, (seen + 1)::INTEGER AS undone, (n - seen)::INTEGER AS distance FROM seen WHERE before <> value AND seen IS NOT NULL AND n - seen <= 250)"""


@query(f"WITH {LOG_SQL}, {REVERSIONS} SELECT * FROM reverted", name="c13_k14_reversions")
def c13_reversions(spark, d):
    return h.reversions(entity_log(spark, d))


ANCESTRY = "up(a, b) AS (SELECT id, parent FROM changes WHERE parent IS NOT NULL UNION ALL SELECT id, merged FROM changes WHERE merged IS NOT NULL), heads(root, node) AS (SELECT 'left', max(id) FROM changes UNION ALL SELECT 'right', max(id) - 7 FROM changes), anc(root, node) AS (SELECT root, node FROM heads UNION SELECT anc.root, up.b FROM anc JOIN up ON up.a = anc.node)"


def two_heads(spark, d):
    c = changes(spark, d)
    top = c.agg(F.max("id").alias("m"))
    return c, top.select(F.explode(F.array(F.struct(F.lit("left").alias("root"), F.col("m").alias("node")), F.struct(F.lit("right").alias("root"), (F.col("m") - 7).alias("node")))).alias("x")).select("x.*")


@query(f"WITH RECURSIVE {CHANGES_SQL}, {ANCESTRY} SELECT node AS change FROM anc JOIN changes c ON c.id = node WHERE root = 'left' AND c.parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id % 40 <> c.author AND e.event_id % 1000 = c.id % 1000 AND e.event_type = 'purchase')")
def c14_unapproved_changes(spark, d):
    c, heads = two_heads(spark, d)
    got = g.ancestry(heads.where("root = 'left'"), c).select(F.col("node").alias("id")).join(c.where("parent is not null"), "id")
    approvals = table(spark, d, "events").where("event_type = 'purchase'").select((F.col("event_id") % 1000).alias("k"), (F.col("user_id") % 40).alias("approver")).distinct()
    return got.withColumn("k", F.col("id") % 1000).join(approvals, (got.id % 1000 == approvals.k) & (F.col("author") != F.col("approver")), "left_anti").select(F.col("id").alias("change"))


@query("WITH tests AS (SELECT DISTINCT l_partkey AS entity, l_suppkey AS test FROM lineitem WHERE l_returnflag = 'R' UNION SELECT l_partkey, o_custkey + 1000000 FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F') SELECT entity, count(*) AS tests FROM tests GROUP BY entity", name="c15_proof_slice")
def c15_proof_slice(spark, d):
    line = table(spark, d, "lineitem")
    direct = line.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("entity"), F.col("l_suppkey").alias("test"))
    work = table(spark, d, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'")
    via = line.join(work, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_partkey").alias("entity"), (F.col("o_custkey") + 1000000).alias("test"))
    return direct.unionByName(via).distinct().groupBy("entity").agg(F.count("*").alias("tests"))


@query("WITH w AS (SELECT o_orderkey AS work FROM orders), impl AS (SELECT l_orderkey AS work, l_partkey AS entity FROM lineitem WHERE l_returnflag = 'R'), scope AS (SELECT l_orderkey AS work, l_partkey AS entity FROM lineitem), e AS (SELECT DISTINCT w.work, entity FROM w JOIN impl USING (work) UNION SELECT w.work, entity FROM w JOIN scope USING (work) WHERE w.work NOT IN (SELECT work FROM impl)) SELECT work, entity FROM e WHERE entity % 3 <> 0", name="c16_work_without_proof")
def c16_work_without_proof(spark, d):
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("work"), F.col("l_partkey").alias("entity"), "l_returnflag")
    work = table(spark, d, "orders").select(F.col("o_orderkey").alias("work"))
    by = line.where("l_returnflag = 'R'").select("work", "entity")
    scoped = line.join(by, "work", "left_anti").select("work", "entity")
    proven = table(spark, d, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("entity"))
    return by.unionByName(scoped).join(work, "work", "left_semi").distinct().join(proven, "entity", "left_anti").select("work", "entity")


@query(E + "SELECT c.id, split_part(c.name, '::', 1) AS owner, count(*) OVER (PARTITION BY split_part(c.name, '::', 1)) AS siblings FROM entities c WHERE contains(c.name, '::')")
def c19_declaration_members(spark, d):
    members = entities(spark, d).where("name like '%::%'").select("id", S.qualifier(F.col("name")).alias("owner"))
    return members.join(members.groupBy("owner").agg(F.count("*").alias("siblings")), "owner").select("id", "owner", "siblings")


DEPS = "deps AS (SELECT DISTINCT c_nationkey AS repo, s_nationkey AS needs FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE c_nationkey <> s_nationkey)"


@query(f"WITH {DEPS} SELECT repo, count(*) AS dependencies, (SELECT count(*) FROM deps x WHERE x.needs = deps.repo) AS consumers FROM deps GROUP BY repo")
def c20_repo_dependencies(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("repo"))
    line = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", F.col("s_nationkey").alias("needs"))
    deps = o.join(line, F.col("o_orderkey") == F.col("l_orderkey")).where("repo <> needs").select("repo", "needs").distinct()
    out = deps.groupBy("repo").agg(F.count("*").alias("dependencies"))
    return out.join(deps.groupBy(F.col("needs").alias("repo")).agg(F.count("*").alias("consumers")), "repo", "left").select("repo", "dependencies", F.coalesce("consumers", F.lit(0)).alias("consumers"))


@query(G + "SELECT r.id, r.dst, e.name, e.file FROM relations r LEFT JOIN entities e ON e.id = r.dst AND e.role = 'Source' WHERE r.kind = 'Calls' AND r.evidence > 1")
def c21_metadata_lookup(spark, d):
    r = relations(spark, d).where("kind = 'Calls' and evidence > 1").select("id", "dst")
    return r.join(entities(spark, d).where("role = 'Source'").select(F.col("id").alias("dst"), "name", "file"), "dst", "left").select("id", "dst", "name", "file")


@query(f"WITH RECURSIVE {CHANGES_SQL}, {ANCESTRY} SELECT (SELECT count(*) FROM anc a WHERE root = 'left' AND node NOT IN (SELECT node FROM anc WHERE root = 'right')) AS ahead, (SELECT count(*) FROM anc WHERE root = 'right' AND node NOT IN (SELECT node FROM anc WHERE root = 'left')) AS behind", name="g2_i10_ahead_behind")
def g2_ahead_behind(spark, d):
    c, heads = two_heads(spark, d)
    return g.ahead_behind(g.ancestry(heads, c), "left", "right")


@query(f"WITH RECURSIVE {CHANGES_SQL}, {ANCESTRY}, common AS (SELECT node FROM anc WHERE root = 'left' INTERSECT SELECT node FROM anc WHERE root = 'right') SELECT node AS base FROM common WHERE node NOT IN (SELECT b FROM up WHERE a IN (FROM common))", name="g3_i10_merge_base")
def g3_merge_base(spark, d):
    c, heads = two_heads(spark, d)
    return g.merge_base(g.ancestry(heads, c), c, "left", "right").select(F.col("node").alias("base"))


FOREST = "forest AS (SELECT event_id AS id, CASE WHEN event_id > 5 THEN (event_id // 6) * 3 + event_id % 3 WHEN event_id > 2 THEN event_id - 3 END AS parent, CASE WHEN event_id > 40 AND event_id % 10 = 0 THEN (event_id // 9) * 3 + event_id % 3 WHEN event_id > 40 AND event_id % 70 = 35 THEN (event_id // 12) * 3 + (event_id + 1) % 3 END AS merged FROM events), pairs AS (SELECT event_id AS pair, event_id // 2 AS base, event_id AS head FROM events WHERE event_id % 25 = 24 UNION ALL SELECT -event_id, event_id // 5, event_id FROM events WHERE event_id % 40 = 0 AND event_id > 0)"


def forest(spark, d):
    """Histories of three beginnings, some merged crosswise."""
    i = F.col("event_id")
    thirds = lambda n, k: F.floor(i / n).cast("long") * 3 + (i + k) % 3
    merged = F.when((i > 40) & (i % 10 == 0), thirds(9, 0)).when((i > 40) & (i % 70 == 35), thirds(12, 1))
    return table(spark, d, "events").select(i.alias("id"), F.when(i > 5, thirds(6, 0)).when(i > 2, i - 3).alias("parent"), merged.alias("merged"))


@query(f"""WITH RECURSIVE {FOREST}, steps(a, b) AS (SELECT id, parent FROM forest WHERE parent IS NOT NULL UNION SELECT id, merged FROM forest WHERE merged IS NOT NULL),
anc(pair, side, node) AS (SELECT pair, unnest(['base', 'head']), unnest([base, head]) FROM pairs UNION SELECT pair, side, b FROM anc JOIN steps ON a = node),
sides AS (SELECT pair, node, bool_or(side = 'base') AS ib, bool_or(side = 'head') AS ih FROM anc GROUP BY ALL), n AS (SELECT pair, count(*) FILTER (ib) AS nb, count(*) FILTER (ih) AS nh, count(*) FILTER (ih AND NOT ib) AS ahead, count(*) FILTER (ib AND NOT ih) AS behind, count(*) FILTER (ib AND ih) AS common FROM sides GROUP BY pair),
best AS (SELECT pair, min(node) AS one, count(*) AS bases FROM sides s WHERE ib AND ih AND NOT EXISTS (SELECT 1 FROM sides t JOIN steps ON a = t.node WHERE t.pair = s.pair AND t.ib AND t.ih AND b = s.node) GROUP BY pair),
r AS (SELECT *, CASE WHEN greatest(nb, nh) > 40 THEN 'history_too_deep' WHEN common = 0 THEN 'no_common_ancestor' WHEN bases > 1 THEN 'ambiguous_merge_base' END AS refusal FROM n LEFT JOIN best USING (pair))
SELECT pair::VARCHAR AS pair, CASE WHEN refusal IS NULL THEN ahead END AS ahead, CASE WHEN refusal IS NULL THEN behind END AS behind, CASE WHEN refusal IS NULL THEN one END AS base, CASE WHEN refusal IS DISTINCT FROM 'history_too_deep' THEN coalesce(bases, 0) END AS bases, refusal FROM r""", name="g2_g3_i10_compare")
def g3_compare(spark, d):
    """Distances and merge bases of many pairs, with refusals: histories that share nothing, that are too deep, or that cross."""
    i = F.col("event_id")
    e = table(spark, d, "events")
    pairs = e.where(i % 25 == 24).select(i.alias("pair"), F.floor(i / 2).cast("long").alias("base"), i.alias("head"))
    pairs = pairs.unionByName(e.where((i % 40 == 0) & (i > 0)).select((-i).alias("pair"), F.floor(i / 5).cast("long").alias("base"), i.alias("head")))
    return g.compare(pairs, forest(spark, d), most=40)


@query(E + f", t AS (SELECT id, name, unnest({TOKENS.format('name')}) AS token FROM entities), hit AS (SELECT token, id, row_number() OVER (PARTITION BY token ORDER BY id) AS n FROM (SELECT DISTINCT token, id FROM t WHERE token IN ('red', 'widget', 'urgent', 'nation'))) SELECT id, count(*) AS tokens FROM hit WHERE n <= 400 GROUP BY id")
def g4_token_union(spark, d):
    from ..operators.retrieval import top

    words = entities(spark, d).select("id", F.explode(F.array_distinct(tokens(F.col("name")))).alias("token")).where("token in ('red', 'widget', 'urgent', 'nation')")
    return top(words, "token", ["id"], 400).groupBy("id").agg(F.count("*").alias("tokens"))


@query("WITH b AS (SELECT l_partkey AS part, l_returnflag AS flag FROM lineitem WHERE l_orderkey % 5 = 0), gone AS (SELECT DISTINCT part, flag FROM b WHERE part % 3 = 0 AND flag = 'R'), come AS (SELECT DISTINCT part, 'X' AS flag FROM b WHERE part % 11 = 0) SELECT part, flag, count(*) AS n FROM (SELECT * FROM b WHERE (part, flag) NOT IN (SELECT (part, flag) FROM gone) UNION ALL FROM come) GROUP BY ALL")
def g5_apply_bag_delta(spark, d):
    b = table(spark, d, "lineitem").where("l_orderkey % 5 = 0").select(F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("flag"))
    gone, come = b.where("part % 3 = 0 and flag = 'R'").distinct(), b.where("part % 11 = 0").select("part", F.lit("X").alias("flag")).distinct()
    return h.apply_bag(b, gone, come).groupBy("part", "flag").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT event_id % 500 AS review, user_id AS reviewer FROM events a WHERE event_type = 'click' AND NOT EXISTS (SELECT 1 FROM events u WHERE u.event_type = 'error' AND u.event_id % 500 = a.event_id % 500 AND u.user_id % 10 = a.user_id % 10)")
def g6_current_assignments(spark, d):
    e = table(spark, d, "events").select((F.col("event_id") % 500).alias("review"), F.col("user_id").alias("reviewer"), "event_type")
    off = e.where("event_type = 'error'").select("review", (F.col("reviewer") % 10).alias("k"))
    return e.where("event_type = 'click'").withColumn("k", F.col("reviewer") % 10).join(off, ["review", "k"], "left_anti").select("review", "reviewer").distinct()

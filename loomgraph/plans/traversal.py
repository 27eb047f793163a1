"""Queries I: traversals of the graph, for many roots at once."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import token_estimate
from ..operators import graph as g
from ..operators import review as rv
from ..sources.store import table
from .filters_and_joins import ANCESTRY, G, IMPACT, INBOUND, two_heads
from .model import CHANGES_SQL, GRAPH_SQL, entities, named, numbered, relations
from .registry import query

RG = f"WITH RECURSIVE {GRAPH_SQL}\n"


def bfs(starts: str, edges: str, depth: int) -> str:
    """SQL of (root, node, hop): starts and edges (a, b) are selects."""
    return f"steps(a, b) AS ({edges}), walk(root, node, hop) AS (SELECT id, id, 0 FROM ({starts}) UNION SELECT root, b, hop + 1 FROM walk JOIN steps ON a = node WHERE hop < {depth}), reached AS (SELECT root, node, min(hop)::INTEGER AS hop FROM walk GROUP BY ALL)"


OUT, IN = "SELECT DISTINCT src, dst FROM relations", "SELECT DISTINCT dst, src FROM relations"
BOTH = f"{OUT} UNION {IN}"
SOME_SUPPLIERS = "SELECT id FROM entities WHERE kind = 'Interface'"


@query(RG + f", {bfs('SELECT id FROM entities WHERE kind = $$Method$$ AND line = 5', OUT, 2)} SELECT root, hop, count(*) AS relations, sum(evidence)::BIGINT AS evidence FROM reached JOIN relations ON src = node WHERE hop < 2 GROUP BY ALL", name="i1_i14_bfs_neighbourhood")
def i1_bfs_neighbourhood(spark, d):
    e = entities(spark, d)
    _, rel = g.neighbourhood(e.where("kind = 'Method' and line = 5").select("id"), e, relations(spark, d), 2)
    hops = g.reach(g.rooted(e.where("kind = 'Method' and line = 5").select("id")), g.steps_of(relations(spark, d)), 1, stored=True).select("root", F.col("node").alias("src"), "hop")
    return rel.join(hops, ["root", "src"]).groupBy("root", "hop").agg(F.count("*").alias("relations"), F.sum("evidence").alias("evidence"))


@query(RG + f", {bfs('SELECT id FROM entities WHERE id IN ($$c:3$$, $$c:4$$)', 'SELECT DISTINCT src, dst FROM relations WHERE kind IN ($$References$$, $$Calls$$) UNION SELECT DISTINCT dst, src FROM relations WHERE kind IN ($$References$$, $$Calls$$)', 2)}, r AS (SELECT node, min(hop) AS hop FROM reached GROUP BY node) SELECT hop, kind, count(*) AS entities FROM r JOIN entities ON id = node GROUP BY ALL", name="i2_i3_expand_neighbourhood")
def i2_expand_neighbourhood(spark, d):
    e = entities(spark, d)
    nodes, _ = g.expand(e.where("id in ('c:3', 'c:4')").select("id"), e, relations(spark, d), 2, ["References", "Calls"])
    return nodes.join(e.select(F.col("id").alias("node"), "kind"), "node").groupBy("hop", "kind").agg(F.count("*").alias("entities"))


@query(RG + f", {bfs('SELECT $$r:0$$ AS id', IN, 3)} SELECT node, kind, hop FROM reached JOIN entities ON id = node WHERE hop > 0", name="i4_downstream_impact")
def i4_downstream_impact(spark, d):
    e = entities(spark, d)
    got = g.downstream(e.where("id = 'r:0'").select("id"), e, relations(spark, d), 3)
    return got.join(e.select(F.col("id").alias("node"), "kind"), "node").select("node", "kind", "hop")


@query(RG + f", {bfs(SOME_SUPPLIERS, IN, 2)} SELECT root, hop, count(*) AS dependents FROM reached JOIN entities ON id = node WHERE hop > 0 GROUP BY ALL", name="i4_impact_of_many_roots")
def i4_impact_of_many_roots(spark, d):
    e = entities(spark, d)
    return g.downstream(e.where("kind = 'Interface'").select("id"), e, relations(spark, d), 2).groupBy("root", "hop").agg(F.count("*").alias("dependents"))


@query(RG + f", {bfs('SELECT $$n:7$$ AS id', BOTH, 3)} SELECT hop, count(*) AS nodes FROM reached GROUP BY hop", name="i5_hop_distances")
def i5_hop_distances(spark, d):
    start = entities(spark, d).where("id = 'n:7'").select("id")
    return g.reach(g.rooted(start), g.steps_of(relations(spark, d), "both"), 3, stored=True).groupBy("hop").agg(F.count("*").alias("nodes"))


POINTS = " ".join(f"WHEN kind IN ({', '.join(repr(k) for k in kinds)}) THEN {n}" for n, kinds in g.RELATION_POINTS)
BUCKET = "CASE WHEN role IN ('Generated', 'Vendored') OR kind = 'DerivedFrom' THEN 'derived' WHEN role = 'Test' OR kind IN ('Tests', 'Covers') THEN 'test' WHEN kind = 'ConsumesContract' THEN 'contract_consumer' WHEN kind IN ('Calls', 'Spawns', 'Instantiates', 'SendsMessage') THEN 'runtime_caller' WHEN kind IN ('Extends', 'Implements', 'Overrides', 'UsesType') THEN 'type_dependent' ELSE 'dependent' END"
BUCKET_SQL = " ".join(f"WHEN '{k}' THEN {v}" for k, v in g.BUCKET_POINTS.items())


@query(RG + f""", {INBOUND}, {bfs('SELECT $$r:1$$ AS id UNION ALL SELECT $$p:8$$', 'SELECT DISTINCT dst, src FROM inbound', 3)},
step AS (SELECT w.root, i.src AS node, w.hop + 1 AS hop, i.kind, i.id, confidence, evidence, e.role FROM reached w JOIN inbound i ON i.dst = w.node JOIN entities e ON e.id = i.src WHERE w.hop < 3 AND i.src <> w.root),
scored AS (SELECT root, node, hop, kind, id, {BUCKET} AS bucket, evidence, confidence FROM step),
points AS (SELECT *, (CASE bucket {BUCKET_SQL} END + CASE {POINTS} ELSE 0 END + greatest(0, 240 - 60 * (hop - 1)) + round(least(1, greatest(0, confidence)) * 100) + CASE WHEN evidence > 1 THEN 25 ELSE 0 END)::INTEGER AS score FROM scored)
SELECT root, node, hop::INTEGER AS hop, bucket, kind, score FROM points QUALIFY row_number() OVER (PARTITION BY root, node ORDER BY score DESC, hop, kind, id) = 1""", name="i6_f2_k16_ranked_impact")
def i6_ranked_impact(spark, d):
    e = entities(spark, d)
    return g.ranked_impact(e.where("id in ('r:1', 'p:8')").select("id"), e, relations(spark, d), 3)


CROSS_REPO = "SELECT DISTINCT 'n' || s_nationkey || '/' || l_partkey % 40, 'n' || c_nationkey || '/' || (l_partkey * 7 + 3) % 40 FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey"


@query(f"WITH RECURSIVE {bfs('SELECT $$n3/7$$ AS id', CROSS_REPO, 3)} SELECT node, hop FROM reached WHERE hop > 0", name="i7_federated_impact")
def i7_federated_impact(spark, d):
    """Along cross-repository edges from what is used to what uses it; a node is repo/entity."""
    line = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    node = lambda repo, n: F.concat(F.lit("n"), F.col(repo), F.lit("/"), n % 40)
    edges = line.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(node("s_nationkey", F.col("l_partkey")).alias("a"), node("c_nationkey", F.col("l_partkey") * 7 + 3).alias("b")).distinct()
    start = spark.createDataFrame([("n3/7",)], "id string")
    return g.reach(g.rooted(start), edges, 3).where("hop > 0").select("node", "hop")


@query(RG + f", {bfs('SELECT $$o:11$$ AS id', OUT, 2)}, intents AS (SELECT o_orderkey AS intent, 'p:' || l_partkey AS scope FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' GROUP BY ALL), direct AS (SELECT intent, min(CASE WHEN hop <= 1 THEN hop ELSE 3 END)::INTEGER AS rank FROM intents JOIN reached ON node = scope GROUP BY intent) SELECT intent, CASE rank WHEN 0 THEN 'direct' WHEN 1 THEN 'direct' ELSE 'downstream' END AS proximity FROM direct", name="i8_traffic_proximity")
def i8_traffic_proximity(spark, d):
    start = entities(spark, d).where("id = 'o:11'").select("id")
    got = g.reach(g.rooted(start), g.steps_of(relations(spark, d)), 2, stored=True).select(F.col("node").alias("scope"), "hop")
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    intents = urgent.join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("intent"), F.concat(F.lit("p:"), F.col("l_partkey").cast("string")).alias("scope")).distinct()
    near = intents.join(got, "scope").groupBy("intent").agg(F.min("hop").alias("hop"))
    return near.select("intent", F.when(F.col("hop") <= 1, "direct").otherwise("downstream").alias("proximity"))


@query(f"WITH RECURSIVE {CHANGES_SQL}, {ANCESTRY} SELECT root, count(*) AS changes, min(author) AS first_author, (SELECT count(*) FROM anc x WHERE node NOT IN (SELECT id FROM changes)) AS missing FROM anc JOIN changes ON id = node GROUP BY root", name="i9_ancestry")
def i9_ancestry(spark, d):
    c, heads = two_heads(spark, d)
    got = g.ancestry(heads, c)
    missing = g.missing_parents(got, c).agg(F.count("*").alias("missing"))
    out = got.join(c, F.col("node") == F.col("id")).groupBy("root").agg(F.count("*").alias("changes"), F.min("author").alias("first_author"))
    return out.join(F.broadcast(missing))  # one row


@query(G + "SELECT r.dst AS target, e.file, count(*) AS sites, sum(evidence)::BIGINT AS occurrences FROM relations r JOIN entities e ON e.id = r.src WHERE r.kind IN ('Calls', 'Imports', 'References') AND r.dst IN ('p:5', 'c:9', 'n:2') GROUP BY ALL", name="i11_find_references")
def i11_find_references(spark, d):
    r = relations(spark, d).where("kind in ('Calls', 'Imports', 'References') and dst in ('p:5', 'c:9', 'n:2')")
    return r.join(entities(spark, d).select(F.col("id").alias("src"), "file"), "src").groupBy(F.col("dst").alias("target"), "file").agg(F.count("*").alias("sites"), F.sum("evidence").alias("occurrences"))


@query(RG + """, steps AS (SELECT DISTINCT src AS a, dst AS b FROM relations),
h1 AS (SELECT a AS via, b AS node FROM steps WHERE a = 'o:21' QUALIFY row_number() OVER (PARTITION BY a ORDER BY b) <= 3), l1 AS (SELECT node, min(via) AS via, 1 AS hop FROM h1 WHERE node <> 'o:21' GROUP BY node),
h2 AS (SELECT a AS via, b AS node FROM steps WHERE a IN (SELECT node FROM l1) QUALIFY row_number() OVER (PARTITION BY a ORDER BY b) <= 3), l2 AS (SELECT node, min(via) AS via, 2 AS hop FROM h2 WHERE node <> 'o:21' AND node NOT IN (SELECT node FROM l1) GROUP BY node)
SELECT 'o:21' AS node, NULL AS via, 0 AS hop UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2""", name="i12_trace_data_flow")
def i12_trace_data_flow(spark, d):
    start = entities(spark, d).where("id = 'o:21'").select("id")
    return g.trace(start, relations(spark, d), 2, 3).select("node", "via", "hop")


@query(RG + """, steps AS (SELECT DISTINCT src AS a, dst AS b FROM relations), p(node, path, hops) AS (SELECT 'o:17', 'o:17', 0 UNION ALL SELECT b, path || '>' || b, hops + 1 FROM p JOIN steps ON a = node WHERE hops < 3)
SELECT hops::INTEGER AS hops, path FROM (SELECT *, row_number() OVER (ORDER BY path) AS n FROM p WHERE node = (SELECT min(b) FROM steps WHERE b LIKE 'r:%' AND a = (SELECT min(b) FROM steps WHERE b LIKE 'n:%' AND a = (SELECT min(b) FROM steps WHERE b LIKE 'c:%' AND a = 'o:17'))) AND hops = (SELECT min(hops) FROM p q WHERE q.node = p.node)) WHERE n <= 5""", name="i13_routes")
def i13_routes(spark, d):
    """Shortest routes from an order to the region of its customer."""
    r = relations(spark, d)
    pick = lambda before, prefix: r.join(before, r.src == before.node).where(F.col("dst").like(prefix)).agg(F.min("dst").alias("node"))
    node = spark.createDataFrame([("o:17",)], "node string")
    for prefix in ("c:%", "n:%", "r:%"):
        node = pick(node, prefix)
    return g.routes(node.select(F.lit("o:17").alias("root"), F.col("node").alias("goal")), r, 3).select("hops", "path")


@query(RG + f", {bfs('SELECT $$o:30$$ AS id', OUT, 2)}, cost AS (SELECT e.id, hop, (n + n // 7)::BIGINT AS tokens FROM (SELECT id, hop, len(regexp_extract_all(signature, '(\\w+|[^\\w\\s])', 1)) AS n FROM reached JOIN entities ON id = node) e), run AS (SELECT *, sum(tokens) OVER (ORDER BY hop, id ROWS UNBOUNDED PRECEDING) AS total FROM cost) SELECT id, hop, tokens, total::BIGINT AS total FROM run WHERE total <= 120", name="i15_context_pack")
def i15_context_pack(spark, d):
    """Entities around a focus by distance, cut where their token estimates fill a budget.

    Only `budget` rows can fit, as each takes a token at least, so the running sum is over a bounded top of the order.
    """
    e, budget = entities(spark, d), 120
    got = g.reach(g.rooted(e.where("id = 'o:30'").select("id")), g.steps_of(relations(spark, d)), 2, stored=True)
    cost = got.join(e.select(F.col("id").alias("node"), "signature"), "node").select(F.col("node").alias("id"), "hop", token_estimate(F.col("signature")).alias("tokens"))
    first = cost.orderBy("hop", "id").limit(budget)
    return first.withColumn("total", F.sum("tokens").over(Window.orderBy("hop", "id").rowsBetween(Window.unboundedPreceding, 0))).where(F.col("total") <= budget)


SECURITY_GRAPH = "e2 AS (SELECT id, visibility, CASE WHEN kind = 'Interface' THEN 'ApiEndpoint' WHEN kind IN ('Module', 'Package') THEN 'EventContract' ELSE kind END AS kind FROM entities), r2 AS (SELECT id, CASE WHEN kind = 'DependsOn' AND evidence > 1 THEN 'Tests' WHEN kind = 'Imports' THEN 'ConsumesContract' ELSE kind END AS kind, src, dst FROM relations)"
INBOUND_2 = INBOUND.replace("FROM relations", "FROM r2")
AGAIN = bfs("SELECT DISTINCT entity AS id FROM found", "SELECT DISTINCT dst, src FROM inbound", 10).replace("steps", "steps2").replace("walk", "walk2").replace("reached", "reached2")


@query(RG + f""", {SECURITY_GRAPH}, {INBOUND_2}, tested AS (SELECT unnest([src, dst]) AS id FROM r2 WHERE kind = 'Tests'), {bfs('SELECT id FROM e2 WHERE visibility = $$Public$$', 'SELECT DISTINCT dst, src FROM inbound', 5)},
found AS (SELECT 'high' AS severity, 'untested-api' AS category, id AS entity, 1 AS n FROM e2 WHERE kind = 'ApiEndpoint' AND id NOT IN (FROM tested)
  UNION ALL SELECT 'low', 'orphaned-public', id, 1 FROM e2 WHERE visibility = 'Public' AND kind IN ('Function', 'Method') AND id NOT IN (FROM tested) AND id NOT IN (SELECT dst FROM r2 WHERE kind = 'Calls')
  UNION ALL SELECT 'medium', 'high-fan-out', root, count(*) FROM reached WHERE hop > 0 GROUP BY root HAVING count(*) > 20
  UNION ALL SELECT 'medium', 'dead-event', id, 1 FROM e2 WHERE kind = 'EventContract' AND id NOT IN (SELECT dst FROM r2 WHERE kind = 'ConsumesContract' AND src <> dst)
  UNION ALL SELECT 'low', 'encapsulation-leak', src, count(*) FROM r2 JOIN e2 a ON a.id = src AND a.visibility = 'Public' JOIN e2 b ON b.id = dst AND b.visibility = 'Private' WHERE r2.kind = 'Calls' GROUP BY src),
{AGAIN}
FROM found UNION ALL SELECT 'info', 'transitive-dependency', node, count(*) FROM reached2 WHERE hop > 0 GROUP BY node""", name="i17_f3_security_findings")
def i17_security_findings(spark, d):
    """All rules and their spread; suppliers stand for endpoints, nations and regions for event contracts, repeated uses of a supplier for tests."""
    k = F.col("kind")
    e = entities(spark, d).select(numbered("id").alias("id"), "visibility", F.when(k == "Interface", "ApiEndpoint").when(k.isin("Module", "Package"), "EventContract").otherwise(k).alias("kind"))
    r = relations(spark, d).select("id", F.when((k == "DependsOn") & (F.col("evidence") > 1), "Tests").when(k == "Imports", "ConsumesContract").otherwise(k).alias("kind"), numbered("src").alias("src"), numbered("dst").alias("dst"))
    return rv.security_findings(e, r).select("severity", "category", named("entity").alias("entity"), "n")


@query(RG + f", {bfs('SELECT $$s:4$$ AS id', IN, 1)} SELECT o_orderstatus AS status, count(DISTINCT node) AS entities, count(DISTINCT l_partkey) AS tests FROM reached JOIN orders ON 'o:' || o_orderkey = node JOIN lineitem ON l_orderkey = o_orderkey WHERE hop > 0 GROUP BY status", name="i18_verification_plan")
def i18_verification_plan(spark, d):
    e = entities(spark, d)
    got = g.downstream(e.where("id = 's:4'").select("id"), e, relations(spark, d), 1)
    o = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("node"), F.col("o_orderstatus").alias("status"), "l_partkey")
    return got.select("node").join(o, "node").groupBy("status").agg(F.count_distinct("node").alias("entities"), F.count_distinct("l_partkey").alias("tests"))


@query(f"WITH RECURSIVE {CHANGES_SQL}, gone(id) AS (SELECT id FROM changes WHERE id % 97 = 5 UNION SELECT c.id FROM changes c JOIN gone g ON c.parent = g.id) SELECT id FROM changes WHERE id NOT IN (FROM gone)", name="i19_closed_records")
def i19_closed_records(spark, d):
    """Changes that stay when some leave and everything that needs a missing parent leaves with them."""
    from .model import changes

    rows = changes(spark, d).where("id % 97 <> 5").select("id", "parent")
    return g.closed(rows, "parent").select("id")




@query(RG + f", {bfs('SELECT id FROM entities WHERE id IN ($$o:30$$, $$o:44$$, $$c:5$$)', OUT, 2)}, needs AS (SELECT root AS id, sum(n + n // 7)::BIGINT AS need FROM (SELECT root, len(regexp_extract_all(signature, '(\\w+|[^\\w\\s])', 1)) AS n FROM reached JOIN entities ON id = node) GROUP BY root), k AS (SELECT id, need, row_number() OVER (ORDER BY need, id) AS k, coalesce(sum(need) OVER (ORDER BY need, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, count(*) OVER () AS m FROM needs), l AS (SELECT *, floor((150 - before) / (m - k + 1))::BIGINT AS level FROM k) SELECT id, need, least(need, coalesce((SELECT level FROM l x WHERE x.level <= x.need ORDER BY k LIMIT 1), need)) AS granted FROM l", name="i16_water_fill")
def i16_water_fill(spark, d):
    """A token budget shared between several focal entities by what their neighbourhoods need."""
    e = entities(spark, d)
    got = g.reach(g.rooted(e.where("id in ('o:30', 'o:44', 'c:5')").select("id")), g.steps_of(relations(spark, d)), 2, stored=True)
    needs = got.join(e.select(F.col("id").alias("node"), "signature"), "node").groupBy(F.col("root").alias("id")).agg(F.sum(token_estimate(F.col("signature"))).alias("need"))
    return g.water_fill(needs, 150)


DEPENDENT = f"SELECT DISTINCT src, dst FROM relations WHERE kind IN {IMPACT} AND dst IN (SELECT id FROM entities)"


@query(RG + f""", {bfs('SELECT $$o:11$$ AS id UNION ALL SELECT $$c:7$$', DEPENDENT, 3)},
intents AS (SELECT o_orderkey AS intent, 'entity' AS kind, 'p:' || l_partkey AS scope, o_orderdate AS opened FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT o_orderkey, 'entity', 'o:' || o_orderkey, o_orderdate FROM orders UNION ALL SELECT o_orderkey, 'file', 'src/n' || (o_custkey % 25) || '/customers.py', o_orderdate FROM orders WHERE o_orderpriority = '2-HIGH'),
live AS (SELECT DISTINCT intent, kind, scope FROM intents WHERE opened >= TIMESTAMP '1996-01-01'),
own AS (SELECT root, file AS own FROM reached JOIN entities ON id = node WHERE hop = 0 AND file IS NOT NULL),
files AS (SELECT root, file, min(hop) AS hop FROM reached JOIN entities ON id = node WHERE hop > 0 AND file IS NOT NULL GROUP BY ALL),
scored AS (SELECT r.root, intent, CASE WHEN hop <= 1 THEN 0 ELSE 2 END AS rank, hop AS distance FROM live JOIN reached r ON kind = 'entity' AND scope = node
  UNION ALL SELECT o.root, intent, 1, 0 FROM live JOIN entities e ON live.kind = 'entity' AND scope = e.id JOIN own o ON o.own = e.file
  UNION ALL SELECT f.root, intent, CASE WHEN hop <= 1 THEN 0 ELSE 2 END, hop FROM live JOIN files f ON kind = 'file' AND scope = f.file LEFT JOIN own o ON o.root = f.root WHERE o.own IS DISTINCT FROM f.file
  UNION ALL SELECT o.root, intent, 1, 0 FROM live JOIN own o ON kind = 'file' AND scope = o.own)
SELECT root, intent, CASE rank WHEN 0 THEN 'direct' WHEN 1 THEN 'same_file' ELSE 'downstream' END AS proximity, distance::INTEGER AS distance FROM scored QUALIFY row_number() OVER (PARTITION BY root, intent ORDER BY rank, distance) = 1""", name="i8_scoped_traffic")
def i8_scoped_traffic(spark, d):
    """Orders as intents: urgent ones on their parts, all on themselves, high ones on a file; those of before 1996 have expired. Whole tables have no budget."""
    o = table(spark, d, "orders")
    row = lambda df, kind, scope: df.select(F.col("o_orderkey").alias("intent"), F.lit(kind).alias("kind"), scope.alias("scope"), F.col("o_orderdate").alias("expires"))
    urgent = o.where("o_orderpriority = '1-URGENT'").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    intents = row(urgent, "entity", F.concat(F.lit("p:"), F.col("l_partkey").cast("string"))).unionByName(row(o, "entity", F.concat(F.lit("o:"), F.col("o_orderkey").cast("string"))))
    intents = intents.unionByName(row(o.where("o_orderpriority = '2-HIGH'"), "file", F.concat(F.lit("src/n"), (F.col("o_custkey") % 25).cast("string"), F.lit("/customers.py"))))
    e = entities(spark, d)
    return g.traffic(e.where("id in ('o:11', 'c:7')").select("id"), e, relations(spark, d), intents, 3, F.lit("1996-01-01").cast("timestamp_ntz"), nodes=None, edges=None)

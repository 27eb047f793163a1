"""Queries over what is known of entities: coverage and plans of proof, signals of retrieval, lookups and diffs in full."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import artifacts as art
from ..operators import filters as fl
from ..operators import graph as g
from ..operators import history as h
from ..operators import retrieval as rt
from ..operators import review as rv
from ..functions import scalars as S
from ..sources import compact
from ..sources.store import checkpoint_dir, dealt, rows_read, table
from .aggregates import CANDIDATES, SCORE, candidates
from .filters_and_joins import E, G
from .history import STORE_SQL, filled_store
from .model import CHANGES_SQL, LOG_SQL, changes, entities, entity_log, relations
from .registry import query
from .retrieval import BM25_ALL, NORMAL, lexical
from .traversal import IN, RG, bfs

COVERED = lambda name, subjects, runs: f"SELECT '{name}' AS scope, count(*) AS total, count(*) FILTER (ok) AS covered, round(coalesce(count(*) FILTER (ok) / nullif(count(*), 0), 0), 6) AS ratio, coalesce(sum(n), 0)::BIGINT AS runs, count(n) AS with_any_run, coalesce(sum(n), 0) > 0 AS trusted FROM ({subjects}) LEFT JOIN (SELECT id, count(*) AS n, bool_or(status = 'passing') AS ok FROM ({runs}) GROUP BY id) USING (id)"
RUN = "CASE l_returnflag WHEN 'A' THEN 'passing' ELSE 'failing' END"


@query(" UNION ALL ".join((COVERED("entities", "SELECT p_partkey AS id FROM part", f"SELECT l_partkey AS id, {RUN} AS status FROM lineitem WHERE l_tax > 0.06"), COVERED("contracts", "SELECT s_suppkey AS id FROM supplier", f"SELECT l_suppkey AS id, {RUN} AS status FROM lineitem WHERE l_tax > 0.06"), COVERED("untested", "SELECT n_nationkey AS id FROM nation", "SELECT l_suppkey AS id, 'x' AS status FROM lineitem WHERE false"))), name="d5_d7_coverage_trust")
def d5_coverage_trust(spark, d):
    """Proof of functions and of contracts by runs, and of something that no run has looked at, which says nothing."""
    line = table(spark, d, "lineitem").where("l_tax > 0.06")
    run = lambda key: line.select(F.col(key).alias("id"), F.when(F.col("l_returnflag") == "A", "passing").otherwise("failing").alias("status"))
    ids = lambda name, key: table(spark, d, name).select(F.col(key).alias("id"))
    out = None
    for scope, subjects, runs in (("entities", ids("part", "p_partkey"), run("l_partkey")), ("contracts", ids("supplier", "s_suppkey"), run("l_suppkey")), ("untested", ids("nation", "n_nationkey"), run("l_suppkey").where("false"))):
        row = rv.proof_coverage(subjects, runs).withColumn("scope", F.lit(scope))
        out = row if out is None else out.unionByName(row)
    return out


@query(RG + f""", {bfs("SELECT id FROM entities WHERE kind = 'Interface' AND line % 4 = 1", IN, 1)}, ends AS (SELECT root, node FROM reached),
tests AS (SELECT 'o:' || l_orderkey AS node, 't' || l_partkey AS test FROM lineitem WHERE l_returnflag = 'R'), work AS (SELECT 'o:' || o_orderkey AS node, 'w' || o_custkey AS work FROM orders WHERE o_orderstatus = 'O'), verifies AS (SELECT 'w' || c_custkey AS work, 't' || (c_custkey * 3) AS test FROM customer),
runs AS (SELECT 't' || l_partkey AS test, max_by(CASE l_returnflag WHEN 'A' THEN 'passing' ELSE 'failing' END, l_orderkey * 10 + l_linenumber) AS status FROM lineitem WHERE l_partkey % 3 > 0 GROUP BY 1),
onwork AS (SELECT DISTINCT root, node, work FROM ends JOIN work USING (node)), chosen AS (SELECT root, node, test FROM ends JOIN tests USING (node) UNION SELECT root, node, test FROM onwork JOIN verifies USING (work))
SELECT root, 'test' AS part, test AS id, status FROM (SELECT DISTINCT root, test FROM chosen) LEFT JOIN runs USING (test) UNION ALL SELECT root, 'entity', node, NULL FROM (SELECT root, node FROM chosen UNION SELECT root, root FROM ends)
UNION ALL SELECT DISTINCT root, 'work', work, NULL FROM onwork JOIN verifies USING (work) WHERE (root, test) IN (SELECT (root, test) FROM chosen)""", name="c15_i18_verification_plan")
def i18_plan(spark, d):
    """What to run for a quarter of the interfaces: tests of all that depends on them, direct and through work, their latest runs, and what they prove."""
    e, text = entities(spark, d), lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    starts = e.where("kind = 'Interface' and line % 4 = 1").select("id")
    line, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    tests = line.where("l_returnflag = 'R'").select(text("o:", "l_orderkey").alias("entity"), text("t", "l_partkey").alias("test"))
    work = o.where("o_orderstatus = 'O'").select(text("o:", "o_orderkey").alias("entity"), text("w", "o_custkey").alias("work"))
    verifies = table(spark, d, "customer").select(text("w", "c_custkey").alias("work"), F.concat(F.lit("t"), (F.col("c_custkey") * 3).cast("string")).alias("test"))
    runs = line.where("l_partkey % 3 > 0").select(text("t", "l_partkey").alias("test"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"), F.when(F.col("l_returnflag") == "A", "passing").otherwise("failing").alias("status"))
    return rv.verification_plan(starts, g.downstream(starts, e, relations(spark, d), 1), tests, work, verifies, runs)


HITS = "hits AS (SELECT query, id, CASE WHEN id % 3 > 0 THEN lexical * 12 END AS bm25, CASE WHEN id % 4 > 0 THEN semantic * 1.4 END AS distance, CASE WHEN id % 5 > 0 THEN graph * 3 END AS graph, CASE WHEN id % 7 > 0 THEN proof * 2 END AS proof, provenance - 0.1 AS provenance FROM candidates)"


@query(f"WITH {CANDIDATES}, {HITS}, s AS (SELECT query, id, coalesce(bm25 / nullif(max(bm25) OVER w, 0), 0) AS lexical, coalesce(greatest(0, 1 - distance), 0) AS semantic, coalesce(graph / nullif(max(graph) OVER w, 0), 0) AS graph, coalesce(least(1, greatest(0, proof)), 0) AS proof, coalesce(least(1, greatest(0, provenance)), 0) AS provenance FROM hits WINDOW w AS (PARTITION BY query)), r AS (SELECT query, id, round({SCORE.format('0.16')}, 6) AS score FROM s) SELECT query, id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM r) WHERE rank <= 20", name="j7_j8_raw_signals")
def j7_raw_signals(spark, d):
    """Raw scores of several arms, some of them missing, as signals by the largest of their query, and the ranking by them."""
    c, i = candidates(spark, d), F.col("id")
    some = lambda n, v: F.when(i % n > 0, v)
    hits = c.select("query", "id", some(3, F.col("lexical") * 12).alias("bm25"), some(4, F.col("semantic") * 1.4).alias("distance"), some(5, F.col("graph") * 3).alias("graph"), some(7, F.col("proof") * 2).alias("proof"), (F.col("provenance") - 0.1).alias("provenance"))
    return rt.rank_candidates(rt.signals_of(hits), 20).select("query", "id", "score", "rank")


#: Each signal's candidates and scores, from an order and its lines: (condition, score).
TEN = {"traceback": ("id % 3 = 0", "first_line"), "search": ("true", "price"), "multihop": ("lines > 2", "suppliers"), "test": ("returned > 0", "returned"), "snippet": ("id % 5 = 1", "price"), "import": ("suppliers > 1", "suppliers"), "error": ("returned > 1", "quantity"), "embedding": ("id % 4 > 0", "(id % 97)"), "cochange": ("lines > 1", "lines"), "projection": ("urgent", "quantity")}
ORDERS_SQL = "f AS (SELECT o_custkey AS query, o_orderkey AS id, round(o_totalprice)::DOUBLE AS price, o_orderpriority = '1-URGENT' AS urgent, count(*)::DOUBLE AS lines, count(DISTINCT l_suppkey)::DOUBLE AS suppliers, (count(*) FILTER (l_returnflag = 'R'))::DOUBLE AS returned, sum(l_quantity)::DOUBLE AS quantity, (-min(l_linenumber))::DOUBLE AS first_line FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"
SHARES = "CASE signal " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in rt.LOCATE.items()) + " END / (60 + row_number() OVER (PARTITION BY query, signal ORDER BY score DESC, id))"


@query(f"WITH {ORDERS_SQL}, s AS ({' UNION ALL '.join(f'SELECT query, id, $${k}$$ AS signal, {v}::DOUBLE AS score FROM f WHERE {c}' for k, (c, v) in TEN.items())}), r AS (SELECT *, {SHARES} AS share FROM s), w AS (SELECT query, id, {', '.join(f'round(coalesce(max(share) FILTER (signal = $${k}$$), 0), 9) AS {k}_score, coalesce(max(share) FILTER (signal = $${k}$$), 0) > 0 AS {k}_there' for k in rt.LOCATE)}, count(DISTINCT signal)::INTEGER AS signals, round(sum(share), 9) AS fused FROM r GROUP BY query, id) SELECT query, id, {', '.join(f'{k}_score, {k}_there::INTEGER AS {k}_present' for k in rt.LOCATE)}, signals, fused, (row_number() OVER (PARTITION BY query ORDER BY fused DESC, id))::INTEGER AS rank FROM w", name="j11_ten_signals")
def j11_ten_signals(spark, d):
    """Every customer's orders located by ten signals: their shares, their presence, the fused score and the rank."""
    line = table(spark, d, "lineitem")
    n = rows_read(line)
    line = dealt(line.select("l_orderkey", "l_suppkey", "l_returnflag", "l_quantity", "l_linenumber"), "l_orderkey", rows=n).groupBy("l_orderkey").agg(F.count("*").cast("double").alias("lines"), F.count_distinct("l_suppkey").cast("double").alias("suppliers"), F.count(F.when(F.col("l_returnflag") == "R", 1)).cast("double").alias("returned"), F.sum("l_quantity").cast("double").alias("quantity"), (-F.min("l_linenumber")).cast("double").alias("first_line"))
    o = dealt(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"), "o_orderkey", rows=n).join(line, F.col("o_orderkey") == F.col("l_orderkey")).withColumns({"query": F.col("o_custkey"), "id": F.col("o_orderkey"), "price": F.round("o_totalprice").cast("double"), "urgent": F.col("o_orderpriority") == "1-URGENT"})
    every = F.array(*[F.when(F.expr(c), F.struct(F.lit(k).alias("signal"), F.expr(v).cast("double").alias("score"))) for k, (c, v) in TEN.items()])
    # by query before the signals: all of rt.locate is by query
    scores = dealt(o.select("query", "id", every.alias("every")), "query", rows=n).select("query", "id", F.explode(F.filter("every", lambda s: s.isNotNull())).alias("s")).select("query", "id", "s.*")
    found = rt.locate(scores)
    return found.select("query", "id", *[F.round(f"{k}_score", 9).alias(f"{k}_score") for k in rt.LOCATE], *[f"{k}_present" for k in rt.LOCATE], "signals", "fused", "rank")


FOREIGN = "CASE WHEN kind = 'Function' AND line % 10 = 3 THEN 'External' ELSE role END AS role, CASE WHEN kind = 'Function' AND line % 20 = 3 THEN NULL ELSE file END AS file"


@query(G + f", e2 AS (SELECT id, {FOREIGN} FROM entities WHERE line % 15 > 0), r2 AS (SELECT id, kind, src, dst, CASE WHEN evidence > 1 OR kind = 'References' OR confidence < 0.97 THEN 'crate/' || origin ELSE '' END AS import_source, CASE WHEN confidence < 0.93 THEN '<' || dst || '.h>' ELSE 'lib::' || origin || '.' || split_part(dst, ':', 1) || '_' || split_part(dst, ':', 2) END AS token FROM relations), f AS (SELECT *, trim(regexp_extract(token, '([^:.]*)$', 1)) AS imported FROM r2 WHERE kind IN ('Calls', 'References') AND import_source <> '') SELECT id, src, dst, imported, import_source AS source FROM f WHERE regexp_matches(imported, '^[\\p{{L}}\\p{{N}}_]+$') AND dst NOT IN (SELECT id FROM e2 WHERE role <> 'External' OR file IS NOT NULL) AND src IN (SELECT id FROM e2)", name="c6_foreign_imports")
def c6_foreign_imports(spark, d):
    """Calls and references into what other repositories own, by the symbol that their evidence names."""
    line, function = F.col("line"), F.col("kind") == "Function"
    e = entities(spark, d).where(line % 15 > 0).select("id", F.when(function & (line % 10 == 3), "External").otherwise(F.col("role")).alias("role"), F.when(~(function & (line % 20 == 3)), F.col("file")).alias("file"))
    far, dst = F.col("confidence"), F.col("dst")
    source = F.when((F.col("evidence") > 1) | (F.col("kind") == "References") | (far < 0.97), F.concat(F.lit("crate/"), "origin")).otherwise("")
    token = F.when(far < 0.93, F.concat(F.lit("<"), dst, F.lit(".h>"))).otherwise(F.concat(F.lit("lib::"), "origin", F.lit("."), F.translate(dst, ":", "_")))
    return fl.unresolved_imports(e, relations(spark, d).select("id", "kind", "src", "dst", source.alias("import_source"), token.alias("token")))


@query("""WITH need AS (SELECT s_suppkey AS interface, unnest([s_suppkey * 3, s_suppkey * 5 + 1])  AS m, unnest([0, 1]) AS k FROM supplier), required AS (SELECT DISTINCT interface, m % 40 AS member, m % 3 AS arity FROM need WHERE k <= interface % 2),
offered AS (SELECT DISTINCT l_orderkey AS class, l_partkey % 40 AS member, l_linenumber % 3 AS arity FROM lineitem), n AS (SELECT interface, count(*) AS n FROM required GROUP BY interface) SELECT interface, class, count(*) AS members FROM required JOIN offered USING (member, arity) JOIN n USING (interface) GROUP BY interface, class, n HAVING count(*) = n""", name="c7_satisfaction_with_arity")
def c7_with_arity(spark, d):
    """Classes that offer every member of an interface with as many parameters."""
    s = F.col("s_suppkey")
    need = table(spark, d, "supplier").select(s.alias("interface"), F.posexplode(F.array(s * 3, s * 5 + 1)).alias("k", "m")).where("k <= interface % 2")
    required = need.select("interface", (F.col("m") % 40).alias("member"), (F.col("m") % 3).alias("arity"))
    offered = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("class"), (F.col("l_partkey") % 40).alias("member"), (F.col("l_linenumber") % 3).alias("arity"))
    return fl.satisfied(required, offered)


WHOLE = {"name": "name", "signature": "signature", "doc_summary": "doc", "body_preview": "body", "file_import_context": "import", "file_surface_context": "surface"}
HIT = "CASE " + " ".join(f"WHEN {'' if f in ('name', 'signature') else chr(107) + 'ind NOT IN ($$Module$$, $$Package$$) AND '}instr(lower({c}), 'the') > 0 THEN '{f}'" for f, c in WHOLE.items()) + " END"


@query(E + f""", surfaces AS (SELECT file, string_agg(DISTINCT kind, ' ' ORDER BY kind) AS surface FROM entities WHERE file IS NOT NULL GROUP BY file), whole AS (SELECT e.*, split_part(text, chr(10), 1) AS doc, text AS body, surface, 'the ' || m.n_name AS import FROM entities e LEFT JOIN documents x ON e.id = 'p:' || x.doc_id LEFT JOIN surfaces USING (file) LEFT JOIN customer c ON e.id = 'c:' || c.c_custkey LEFT JOIN nation m ON m.n_nationkey = c.c_nationkey)
SELECT id, field, substr(t, greatest(pos - 8, 1), least(pos - 1, 8) + 11) AS excerpt FROM (SELECT id, field, t, instr(lower(t), 'the') AS pos FROM (SELECT id, {HIT} AS field, CASE {HIT} {' '.join(f"WHEN '{f}' THEN {c}" for f, c in WHOLE.items())} END AS t FROM whole) WHERE field IS NOT NULL) ORDER BY id LIMIT 100""", name="b7_six_fields")
def b7_six_fields(spark, d):
    """A literal in any of the six fields of whole entities; the first field that has it counts."""
    e = entities(spark, d)
    doc = table(spark, d, "documents").select(F.concat(F.lit("p:"), F.col("doc_id").cast("string")).alias("id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("doc_summary"), F.col("text").alias("body_preview"))
    surface = e.where("file is not null").groupBy("file").agg(F.concat_ws(" ", F.array_sort(F.collect_set("kind"))).alias("file_surface_context"))
    imports = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("id"), F.concat(F.lit("the "), "n_name").alias("file_import_context"))
    whole = e.join(doc, "id", "left").join(surface, "file", "left").join(imports, "id", "left")
    return fl.lexical_lookup(whole, "THE", 100, 8, fl.WHOLE_FIELDS)


@query("SELECT event_id AS id, 'u' || user_id AS actor, event_type AS action, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp, CASE WHEN event_id % 3 > 0 THEN 'file:src/' || (event_id % 30) END AS scope FROM events WHERE starts_with('u' || user_id, 'u1') AND event_id % 3 > 0 AND contains('file:src/' || (event_id % 30), 'src/2') ORDER BY stamp DESC, id DESC LIMIT 100", name="b18_audit_scope")
def b18_audit_scope(spark, d):
    """Events of some actors in a scope; events without a scope are in none."""
    i = F.col("event_id")
    log = table(spark, d, "events").select(i.alias("id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("actor"), F.col("event_type").alias("action"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), F.when(i % 3 > 0, F.concat(F.lit("file:src/"), (i % 30).cast("string"))).alias("scope"))
    return fl.audit(log, "u1*", None, None, 100, "src/2").withColumnRenamed("at", "stamp")


DECLARED = "declared AS (SELECT CASE WHEN p_partkey % 5 > 0 THEN 'cli.' || replace(p_name, ' ', '_') || '_' || p_partkey END AS symbol, CASE WHEN p_partkey % 3 > 0 THEN lower(p_brand) || '.f' || p_size END AS module, CASE WHEN p_partkey % 3 = 0 THEN './' || lower(p_brand) || '/f' || (p_size + p_partkey % 2) || '.go' END AS file FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 7 = 0)"


@query(E + f", {DECLARED}, e2 AS (SELECT id, CASE WHEN line % 9 = 0 THEN 'main' ELSE name END AS name, file, regexp_replace(replace(regexp_replace(file, '\\.[^./]*$', ''), '/', '.'), '\\.__init__$', '') AS module FROM entities WHERE kind = 'Function') SELECT DISTINCT e2.id FROM e2 JOIN declared d ON CASE WHEN d.symbol IS NULL THEN name IN ('main', '__main__', 'Main') ELSE d.symbol = name OR regexp_extract(d.symbol, '([^:.]*)$', 1) = regexp_extract(name, '([^:.]*)$', 1) END AND CASE WHEN d.module IS NOT NULL THEN e2.module = d.module OR ends_with(e2.module, '.' || d.module) ELSE e2.file = ltrim(d.file, './') OR ends_with(e2.file, '/' || ltrim(d.file, './')) END", name="b20_declared_entry_points")
def b20_declared_entry_points(spark, d):
    """Functions that manifests declare by symbol and module, by symbol and file, or by a file alone."""
    i = F.col("p_partkey")
    brand, size = F.lower("p_brand"), F.col("p_size")
    declared = table(spark, d, "part").where((i % 2 == 0) | (i % 7 == 0)).select(
        F.when(i % 5 > 0, F.concat(F.lit("cli."), F.regexp_replace("p_name", " ", "_"), F.lit("_"), i.cast("string"))).alias("symbol"), F.when(i % 3 > 0, F.concat(brand, F.lit(".f"), size.cast("string"))).alias("module"), F.when(i % 3 == 0, F.concat(F.lit("./"), brand, F.lit("/f"), (size + i % 2).cast("string"), F.lit(".go"))).alias("file")
    )
    e = entities(spark, d).where("kind = 'Function'").withColumn("name", F.when(F.col("line") % 9 == 0, "main").otherwise(F.col("name")))
    return fl.entry_points(e, declared)


VERSIONS = "o AS (SELECT id, file, signature, visibility, line, size FROM entities WHERE line % 11 > 0), n AS (SELECT id, CASE WHEN line % 19 = 0 THEN 'moved/' || file ELSE file END AS file, CASE WHEN line % 17 = 0 THEN signature || '?' ELSE signature END AS signature, visibility, CASE WHEN line % 4 = 0 THEN line + 1 ELSE line END AS line, size FROM entities WHERE line % 12 > 0), d AS (SELECT coalesce(o.id, n.id) AS id, o.file AS of, n.file AS nf, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN o.signature <> n.signature OR o.visibility <> n.visibility THEN 'modified' WHEN o.line <> n.line OR o.file IS DISTINCT FROM n.file THEN 'suppressed' END AS change FROM o FULL JOIN n ON o.id = n.id)"
PARTS = {"all": "true", "files": "(of IN ('src/n4/customers.py', 'src/n7/suppliers.rs') OR nf IN ('src/n4/customers.py', 'src/n7/suppliers.rs'))", "ids": "(id LIKE 'c:%')"}


@query(E + f", {VERSIONS} " + " UNION ALL ".join(f"SELECT '{p}' AS part, change, coalesce(nf, of) AS file, count(*) AS n FROM d WHERE {w} AND change <> 'suppressed' GROUP BY ALL UNION ALL SELECT '{p}', 'suppressed', NULL, count(*) FILTER (change = 'suppressed') FROM d WHERE {w}" for p, w in PARTS.items()), name="k6_k7_semantic_diff")
def k6_semantic_diff(spark, d):
    """Changes between two versions by file, edits of places alone suppressed and counted: of everything, of some files, of some ids."""
    e, line = entities(spark, d), F.col("line")
    old = e.where(line % 11 > 0)
    new = e.where(line % 12 > 0).withColumns({"file": F.when(line % 19 == 0, F.concat(F.lit("moved/"), "file")).otherwise(F.col("file")), "signature": F.when(line % 17 == 0, F.concat("signature", F.lit("?"))).otherwise(F.col("signature")), "line": F.when(line % 4 == 0, line + 1).otherwise(line)})
    out = None
    for part, only in (("all", {}), ("files", {"files": ["src/n4/customers.py", "src/n7/suppliers.rs"]}), ("ids", {"ids": e.where("kind = 'Class'").select("id")})):
        found, hidden = h.semantic_diff(old, new, "id", ["signature", "visibility"], ["line", "file"], **only)
        rows = found.groupBy("change", "file").agg(F.count("*").alias("n")).unionByName(hidden.select(F.lit("suppressed").alias("change"), F.lit(None).cast("string").alias("file"), F.col("suppressed").alias("n")))
        rows = rows.select(F.lit(part).alias("part"), "change", "file", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


# Words of the documents as known repositories, packages and services.
REGISTRY = ["the", "and", "der", "und", "la", "que", "de", "los"]
PACKAGES, PORTS = {w: f"{w}-repo" for w in ("the", "and", "de", "la", "to", "in")}, {8000 + i: w for i, w in enumerate([*REGISTRY, "other"])}
#: By number of the document: the path of a file, and each word as a line of it.
FILES = (("Dockerfile.dev", "FROM acme/$1:1"), ("docker-compose.yml", "build: './svc/$1/'"), (".github/workflows/ci.yml", "- uses: actions/checkout@v4\n  with:\n    repository: acme/$1"), ("src/main.rs", "use $1::x;"), ("src/run.py", "subprocess.run(['$1'])"), ("src/net.ts", "get('localhost:800$1')"))
WORDS_SQL = "w AS (SELECT source AS repo, doc_id % 6 AS k, unnest(list_filter(string_split_regex(text, '[ \\t\\n\\f\\r]+'), lambda x: x <> '')) AS word FROM documents)"
TAIL_SQL = "split_part(string_split(word, '/')[-1], ':', 1)"
LIST = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"


@query(f"""WITH {WORDS_SQL}, found AS (SELECT repo, 'docker:' || {TAIL_SQL} AS name, {TAIL_SQL} AS provider, 'dockerfile' AS source FROM w WHERE k = 0 UNION SELECT repo, 'compose-build:' || word, word, 'compose' FROM w WHERE k = 1 AND word IN {LIST(REGISTRY)}
  UNION SELECT repo, 'ci:' || string_split(word, '/')[-1], string_split(word, '/')[-1], 'ci' FROM (SELECT repo, k, regexp_replace(word, '["'']+$', '') AS word FROM w) WHERE k = 2 UNION SELECT repo, 'import:' || word, word || '-repo', 'protocol' FROM w WHERE k = 3 AND word IN {LIST(PACKAGES)}
  UNION SELECT repo, 'bin:' || word, word, 'subprocess' FROM w WHERE k = 4 AND word IN {LIST(REGISTRY)} UNION SELECT repo, 'http:localhost:800' || d, list_extract({REGISTRY}, d::INTEGER + 1), 'http' FROM (SELECT repo, regexp_extract(word, '^[0-9]+') AS d FROM w WHERE k = 5) WHERE d IN ('0', '1', '2', '3', '4', '5', '6', '7')) SELECT * FROM found""", name="a18_detected_dependencies")
def a18_detected_dependencies(spark, d):
    """Infrastructure, workflows, imports, programs and local services in files that hold every word of the documents."""
    doc, text = F.col("doc_id") % 6, F.lit(None).cast("string")
    path = F.lit(None).cast("string")
    for k, (name, line) in enumerate(FILES):
        text = F.when(doc == k, F.regexp_replace("text", r"([^ \t\n\f\r]+)[ \t\n\f\r]*", line + "\n")).otherwise(text)
        path = F.when(doc == k, F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit("/" + name))).otherwise(path)
    files = table(spark, d, "documents").where("text is not null").select(F.col("source").alias("repo"), path.alias("path"), text.alias("text"))
    return art.detected(files, REGISTRY, "acme", PACKAGES, PORTS)


@query(f"WITH {WORDS_SQL.replace('doc_id % 6 AS k', 'doc_id AS k')} SELECT DISTINCT k AS doc_id, word AS script, 'pkg.' || word AS module, 'main' AS symbol FROM w WHERE regexp_matches(word, '^[A-Za-z0-9_.-]+$')", name="a19_scripts_of_manifests")
def a19_scripts_of_manifests(spark, d):
    """Scripts that manifests declare, of which each holds every word of a document."""
    lines = F.regexp_replace("text", r"([^ \t\n\f\r]+)[ \t\n\f\r]*", '$1 = "pkg.$1:main"\n')
    files = table(spark, d, "documents").where("text is not null").select(F.concat(F.col("doc_id").cast("string"), F.lit("/pyproject.toml")).alias("path"), F.concat(F.lit("[project.scripts]\n"), lines, F.lit("[tool.x]\n")).alias("text"))
    return art.entry_points(files).select(F.substring_index("path", "/", 1).cast("long").alias("doc_id"), "script", "module", "symbol").distinct()


@query(f"WITH {STORE_SQL}, last AS (SELECT * FROM (FROM d1 UNION ALL FROM d2) QUALIFY row_number() OVER (PARTITION BY id ORDER BY gen DESC) = 1), rows AS (SELECT id, balance FROM base WHERE id NOT IN (SELECT id FROM last) UNION ALL SELECT id, balance FROM last WHERE op <> 'removed') SELECT id, round(balance, 2) AS balance, 1::BIGINT AS folders FROM rows", name="a5_cleared_deltas")
def a5_cleared_deltas(spark, d):
    """The table after its deltas were folded into a snapshot and cleared: only that snapshot and the first one are left."""
    store = filled_store(spark, d)
    generation = store.save_snapshot(store.recover("id"), store.generation())
    store.clear_deltas()
    return store.recover("id").select("id", F.round("balance", 2).alias("balance"), F.lit(len([g for g in store.marks() if g > 1 and g <= generation])).cast("long").alias("folders"))


@query(G + "SELECT id, kind, name, file, coalesce(i, 0) AS incoming, coalesce(o, 0) AS outgoing FROM entities LEFT JOIN (SELECT dst AS id, count(DISTINCT src) AS i FROM relations GROUP BY dst) USING (id) LEFT JOIN (SELECT src AS id, count(DISTINCT dst) AS o FROM relations GROUP BY src) USING (id)", name="a10_saved_index")
def a10_saved_index(spark, d):
    """The compact index, saved, and opened again by its checksum."""
    path, rows = f"{checkpoint_dir(spark)}/compact-{uuid.uuid4().hex}", compact.build(entities(spark, d), relations(spark, d))
    compact.save(rows, path)
    return compact.load(spark, path, rows.schema)


@query(f"WITH n AS (SELECT doc_id, sha256({NORMAL}) AS now, doc_id % 7 = 0 AS edited, doc_id % 11 = 0 AS gone FROM documents), old AS (SELECT doc_id, sha256({NORMAL}) AS was FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || ' x' WHEN doc_id % 5 = 0 THEN text || '   ' || chr(10) || '// note' ELSE text END AS text FROM documents)) SELECT doc_id, CASE WHEN gone THEN 'orphaned' WHEN was = now THEN 'fresh' ELSE 'stale' END AS staleness FROM old JOIN n USING (doc_id)", name="k22_staleness_by_fingerprint")
def k22_staleness(spark, d):
    """Annotations anchored to what documents were: only edits of their content make them stale, comments and white space don't."""
    docs, i, text = table(spark, d, "documents"), F.col("doc_id"), F.col("text")
    was = F.when(i % 7 == 0, F.concat(text, F.lit(" x"))).when(i % 5 == 0, F.concat(text, F.lit("   \n// note"))).otherwise(text)
    notes = docs.select("doc_id", S.fingerprint(was).alias("was"))
    now = docs.where(i % 11 > 0).select("doc_id", S.fingerprint(text).alias("now"))
    return notes.join(now, "doc_id", "left").select("doc_id", F.when(F.col("now").isNull(), "orphaned").when(F.col("was").eqNullSafe(F.col("now")), "fresh").otherwise("stale").alias("staleness"))


@query("WITH a AS (SELECT event_id // 3 AS change, user_id AS actor, CASE event_type WHEN 'purchase' THEN 'approved' ELSE 'rejected' END AS decision FROM events WHERE event_type IN ('purchase', 'view')), who AS (SELECT DISTINCT user_id AS actor, CASE WHEN user_id % 3 = 1 THEN 'Human' ELSE 'Agent' END AS kind FROM events WHERE user_id % 3 < 2), g AS (SELECT user_id AS actor, min(user_id % 10) AS principal FROM events WHERE event_type = 'signup' GROUP BY 1) SELECT change, actor, coalesce(kind, 'Unknown') AS kind, decision, principal, count(*) AS n FROM a LEFT JOIN who USING (actor) LEFT JOIN g USING (actor) GROUP BY ALL", name="k25_approvals_by_change")
def k25_approvals_by_change(spark, d):
    """Who approved or rejected each change, what kind of actor that is, and on whose behalf."""
    from .history import approvals_and_actors

    a, who = approvals_and_actors(spark, d)
    behalf = table(spark, d, "events").where("event_type = 'signup'").groupBy(F.col("user_id").alias("actor")).agg(F.min(F.col("user_id") % 10).alias("principal"))
    rows = a.join(who, "actor", "left").join(behalf, "actor", "left").fillna("Unknown", ["kind"])
    return rows.groupBy("change", "actor", "kind", "decision", "principal").agg(F.count("*").alias("n"))


@query(f'''WITH {LOG_SQL}, {CHANGES_SQL}, b AS (SELECT entity, ord, value FROM (SELECT *, lag(value) OVER w AS before, row_number() OVER w AS n FROM entity_log WHERE op <> 'removed' WINDOW w AS (PARTITION BY entity ORDER BY ord)) WHERE n = 1 OR before <> value) SELECT entity, ord AS change, value, author, strftime("at", '%Y-%m-%d %H:%M:%S') AS stamp, parent FROM b JOIN changes ON id = ord''', name="k4_blame_with_changes")
def k4_blame_with_changes(spark, d):
    """Each revision that changed an entity's value, with its change's author, time and parent."""
    log, c = entity_log(spark, d), changes(spark, d)
    ref = log.agg(F.max("ord").alias("m")).first().m or 0
    b = h.blame(log, ref).select("entity", F.col("ord").alias("id"), "value")
    return b.join(c, "id").select("entity", F.col("id").alias("change"), "value", "author", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("stamp"), "parent")


@query(E + f", {BM25_ALL} SELECT query, doc_id, score, role FROM (SELECT query, doc_id, round(score, 4) AS score FROM bm QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(score, 4) DESC, doc_id) <= 10) LEFT JOIN entities ON id = 'p:' || doc_id", name="j4_hits_with_roles")
def j4_hits_with_roles(spark, d):
    """Search hits with the role of the entity that each document belongs to; scores and order stay, hits without one too."""
    hits = rt.top(lexical(spark, d).withColumn("score", F.round("score", 4)), "query", [F.desc("score"), "doc_id"], 10)
    roles = entities(spark, d).where("kind = 'Function'").select(F.substring("id", 3, 20).cast("long").alias("doc_id"), "role")
    return hits.join(roles, "doc_id", "left").select("query", "doc_id", "score", "role")

"""The property-graph tables, projected from the star-schema tables, as DataFrames and as SQL.

entities: id, kind, name, language, file, role, visibility, line, signature, size
relations: id, kind, src, dst, confidence, origin, evidence (how often it was seen)
entity_log: ord, entity, op, value, note: changes of entities, oldest first
changes: id, first and second parent, author, at
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import dealt, table

ENTITY = ("id", "kind", "name", "language", "file", "role", "visibility", "line", "signature", "size")


def entities(spark: SparkSession, d: str) -> DataFrame:
    def rows(df, prefix, key, kind, name, language, file, role, public, line, signature, size):
        return df.select(
            F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("kind"), name.cast("string").alias("name"), F.lit(language).alias("language"), file.alias("file"), role.alias("role"),
            F.when(public, "Public").otherwise("Private").alias("visibility"), line.cast("int").alias("line"), signature.alias("signature"), size.cast("long").alias("size"),
        )

    source, c = F.lit("Source"), F.col
    out = [
        rows(table(spark, d, "region"), "r:", "r_regionkey", "Package", c("r_name"), "Hcl", F.lit(None).cast("string"), source, F.lit(True), F.lit(1), F.concat(F.lit("package "), c("r_name")), F.lit(10)),
        rows(table(spark, d, "nation"), "n:", "n_nationkey", "Module", c("n_name"), "Python", F.concat(F.lit("regions/"), c("n_regionkey"), F.lit(".py")), source, F.lit(True), c("n_nationkey") + 1, F.concat(F.lit("module  "), c("n_name")), F.lit(20)),
        rows(table(spark, d, "supplier"), "s:", "s_suppkey", "Interface", c("s_name"), "Rust", F.concat(F.lit("src/n"), c("s_nationkey"), F.lit("/suppliers.rs")), F.when(c("s_suppkey") % 7 == 0, "Generated").otherwise("Source"), c("s_suppkey") % 3 > 0, c("s_suppkey") % 500 + 1, F.concat(F.lit("trait "), c("s_name"), F.lit("<T: Into<u8>>")), c("s_acctbal")),
        rows(table(spark, d, "customer"), "c:", "c_custkey", "Class", F.concat(F.initcap(c("c_mktsegment")), F.lit("::"), c("c_name")), "Python", F.concat(F.lit("src/n"), c("c_nationkey"), F.lit("/customers.py")), source, c("c_custkey") % 4 > 0, c("c_custkey") % 900 + 1, F.concat(F.lit("class "), c("c_name"), F.lit("(Base)")), F.abs("c_acctbal")),
        rows(table(spark, d, "part"), "p:", "p_partkey", "Function", F.concat(F.regexp_replace("p_name", " ", "_"), F.lit("_"), c("p_partkey")), "Go", F.concat(F.when(c("p_size") % 10 == 0, "tests/").otherwise("lib/"), F.lower("p_brand"), F.lit("/f"), c("p_size"), F.lit(".go")), F.when(c("p_size") % 10 == 0, "Test").otherwise("Source"), c("p_partkey") % 5 > 0, c("p_partkey") % 700 + 1, F.concat(F.lit("func "), F.regexp_replace("p_name", " ", "_"), F.lit("(x int, y string)")), c("p_size")),
        rows(table(spark, d, "orders"), "o:", "o_orderkey", "Method", F.concat(F.lit("Order."), F.regexp_extract("o_orderpriority", "[A-Z]+", 0), F.lit("_"), c("o_orderkey")), "Java", F.when(c("o_orderstatus") != "P", F.concat(F.lit("app/"), c("o_custkey") % 97, F.lit("/Order.java"))), source, c("o_orderstatus") == "F", c("o_orderkey") % 800 + 1, F.concat(F.lit("void  run"), c("o_orderkey"), F.lit("()")), c("o_totalprice") / 1000),
    ]
    df = out[0]
    for other in out[1:]:
        df = df.unionByName(other)
    return df


def relations(spark: SparkSession, d: str) -> DataFrame:
    def rows(df, kind, src, dst, confidence=1.0, origin="Parsed", evidence=1):
        src, dst = (F.concat(F.lit(p), F.col(k).cast("string")) for p, k in (src, dst))
        lit = lambda v: v if not isinstance(v, (int, float)) else F.lit(v)
        return df.select(F.concat(F.lit(kind + ":"), src, F.lit(">"), dst).alias("id"), F.lit(kind).alias("kind"), src.alias("src"), dst.alias("dst"), lit(confidence).cast("double").alias("confidence"), F.lit(origin).alias("origin"), lit(evidence).cast("long").alias("evidence"))

    line = dealt(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_discount"), "l_orderkey")
    seen = lambda key: line.groupBy("l_orderkey", key).agg(F.max("l_discount").alias("discount"), F.count("*").alias("n"))
    conf = F.round(1 - F.col("discount"), 2)
    out = rows(seen("l_partkey"), "Calls", ("o:", "l_orderkey"), ("p:", "l_partkey"), conf, "Parsed", F.col("n"))
    for other in (
        rows(seen("l_suppkey"), "DependsOn", ("o:", "l_orderkey"), ("s:", "l_suppkey"), conf, "Inferred", F.col("n")),
        rows(table(spark, d, "orders"), "References", ("o:", "o_orderkey"), ("c:", "o_custkey"), 0.95, "Lsp"),
        rows(table(spark, d, "customer"), "Imports", ("c:", "c_custkey"), ("n:", "c_nationkey"), 0.8, "Parsed"),
        rows(table(spark, d, "customer"), "Contains", ("n:", "c_nationkey"), ("c:", "c_custkey")),
        rows(table(spark, d, "supplier"), "Implements", ("s:", "s_suppkey"), ("n:", "s_nationkey"), 0.9, "Inferred"),
        rows(table(spark, d, "nation"), "Extends", ("n:", "n_nationkey"), ("r:", "n_regionkey")),
        rows(table(spark, d, "nation"), "Contains", ("r:", "n_regionkey"), ("n:", "n_nationkey"), 1.0, "Manual"),
    ):
        out = out.unionByName(other)
    return out


#: The first letters of ids.
PREFIXES = "rnscpo"


def numbered(id) -> Column:
    """The id of an entity as one number, which is less to move than its text: eight times its key and the place of its prefix."""
    return F.substring(id, 3, 20).cast("long") * 8 + F.instr(F.lit(PREFIXES), F.substring(id, 1, 1))


def named(number) -> Column:
    """The id that a number stands for."""
    return F.concat(F.substring(F.lit(PREFIXES), F.col(number).bitwiseAND(7).cast("int"), F.lit(1)), F.lit(":"), F.shiftright(number, 3).cast("string"))


def entity_log(spark: SparkSession, d: str) -> DataFrame:
    op = F.when(F.col("event_type") == "signup", "added").when(F.col("event_type") == "error", "removed").otherwise("modified")
    return table(spark, d, "events").select(F.col("event_id").alias("ord"), F.concat(F.lit("u:"), F.col("user_id").cast("string")).alias("entity"), op.alias("op"), F.floor(F.col("value") / 10).cast("long").alias("value"), F.col("event_type").alias("note"))


def changes(spark: SparkSession, d: str) -> DataFrame:
    """Two histories that share their beginnings: a change's first parent is its half, every fifth has a second, its third."""
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("id"), F.when(F.col("event_id") > 0, F.floor(F.col("event_id") / 2)).cast("long").alias("parent"), F.when((F.col("event_id") % 5 == 0) & (F.col("event_id") > 0), F.floor(F.col("event_id") / 3)).cast("long").alias("merged"),
        (F.col("user_id") % 40).alias("author"), F.col("ts").alias("at"),
    )


ENTITIES_SQL = """entities AS (
  SELECT 'r:' || r_regionkey AS id, 'Package' AS kind, r_name AS name, 'Hcl' AS language, NULL::VARCHAR AS file, 'Source' AS role, 'Public' AS visibility, 1 AS line, 'package ' || r_name AS signature, 10::BIGINT AS size FROM region
  UNION ALL SELECT 'n:' || n_nationkey, 'Module', n_name, 'Python', 'regions/' || n_regionkey || '.py', 'Source', 'Public', n_nationkey + 1, 'module  ' || n_name, 20 FROM nation
  UNION ALL SELECT 's:' || s_suppkey, 'Interface', s_name, 'Rust', 'src/n' || s_nationkey || '/suppliers.rs', CASE WHEN s_suppkey % 7 = 0 THEN 'Generated' ELSE 'Source' END, CASE WHEN s_suppkey % 3 > 0 THEN 'Public' ELSE 'Private' END, (s_suppkey % 500 + 1)::INTEGER, 'trait ' || s_name || '<T: Into<u8>>', trunc(s_acctbal)::BIGINT FROM supplier
  UNION ALL SELECT 'c:' || c_custkey, 'Class', upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || '::' || c_name, 'Python', 'src/n' || c_nationkey || '/customers.py', 'Source', CASE WHEN c_custkey % 4 > 0 THEN 'Public' ELSE 'Private' END, (c_custkey % 900 + 1)::INTEGER, 'class ' || c_name || '(Base)', trunc(abs(c_acctbal))::BIGINT FROM customer
  UNION ALL SELECT 'p:' || p_partkey, 'Function', replace(p_name, ' ', '_') || '_' || p_partkey, 'Go', CASE WHEN p_size % 10 = 0 THEN 'tests/' ELSE 'lib/' END || lower(p_brand) || '/f' || p_size || '.go', CASE WHEN p_size % 10 = 0 THEN 'Test' ELSE 'Source' END, CASE WHEN p_partkey % 5 > 0 THEN 'Public' ELSE 'Private' END, (p_partkey % 700 + 1)::INTEGER, 'func ' || replace(p_name, ' ', '_') || '(x int, y string)', p_size FROM part
  UNION ALL SELECT 'o:' || o_orderkey, 'Method', 'Order.' || regexp_extract(o_orderpriority, '[A-Z]+') || '_' || o_orderkey, 'Java', CASE WHEN o_orderstatus <> 'P' THEN 'app/' || (o_custkey % 97) || '/Order.java' END, 'Source', CASE WHEN o_orderstatus = 'F' THEN 'Public' ELSE 'Private' END, (o_orderkey % 800 + 1)::INTEGER, 'void  run' || o_orderkey || '()', trunc(o_totalprice / 1000)::BIGINT FROM orders)"""

RELATIONS_SQL = """edges AS (
  SELECT 'Calls' AS kind, 'o:' || l_orderkey AS src, 'p:' || l_partkey AS dst, round(1 - max(l_discount), 2) AS confidence, 'Parsed' AS origin, count(*) AS evidence FROM lineitem GROUP BY l_orderkey, l_partkey
  UNION ALL SELECT 'DependsOn', 'o:' || l_orderkey, 's:' || l_suppkey, round(1 - max(l_discount), 2), 'Inferred', count(*) FROM lineitem GROUP BY l_orderkey, l_suppkey
  UNION ALL SELECT 'References', 'o:' || o_orderkey, 'c:' || o_custkey, 0.95, 'Lsp', 1 FROM orders
  UNION ALL SELECT 'Imports', 'c:' || c_custkey, 'n:' || c_nationkey, 0.8, 'Parsed', 1 FROM customer
  UNION ALL SELECT 'Contains', 'n:' || c_nationkey, 'c:' || c_custkey, 1.0, 'Parsed', 1 FROM customer
  UNION ALL SELECT 'Implements', 's:' || s_suppkey, 'n:' || s_nationkey, 0.9, 'Inferred', 1 FROM supplier
  UNION ALL SELECT 'Extends', 'n:' || n_nationkey, 'r:' || n_regionkey, 1.0, 'Parsed', 1 FROM nation
  UNION ALL SELECT 'Contains', 'r:' || n_regionkey, 'n:' || n_nationkey, 1.0, 'Manual', 1 FROM nation),
relations AS (SELECT kind || ':' || src || '>' || dst AS id, kind, src, dst, confidence::DOUBLE AS confidence, origin, evidence::BIGINT AS evidence FROM edges)"""

LOG_SQL = """entity_log AS (SELECT event_id AS ord, 'u:' || user_id AS entity, CASE event_type WHEN 'signup' THEN 'added' WHEN 'error' THEN 'removed' ELSE 'modified' END AS op, floor(value / 10)::BIGINT AS value, event_type AS note FROM events)"""

CHANGES_SQL = """changes AS (SELECT event_id AS id, CASE WHEN event_id > 0 THEN event_id // 2 END AS parent, CASE WHEN event_id % 5 = 0 AND event_id > 0 THEN event_id // 3 END AS merged, user_id % 40 AS author, ts AS at FROM events)"""
GRAPH_SQL = f"{ENTITIES_SQL},\n{RELATIONS_SQL}"

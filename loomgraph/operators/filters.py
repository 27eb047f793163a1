"""Entity, relation, work and audit filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import cut, dealt

# Relation kinds along which a change can break something.
IMPACT_KINDS = ("Extends", "Implements", "Overrides", "Calls", "Spawns", "Instantiates", "References", "UsesMacro", "UsesType", "Imports", "Includes", "DependsOn", "ConsumesContract", "SubscribesTo", "SendsMessage", "Tests", "Covers", "DerivedFrom")
# Entity kinds that can be unreferenced code.
CODE_KINDS = ("Function", "Method", "Class", "Interface", "TraitDef", "TypeAlias", "EnumDef", "Constant", "StaticVar")
# Fixed value: a pattern for files of tests, examples and benchmarks, by the lower-cased path with forward slashes.
NONPRODUCTION = r"(^|/)(tests?|testing|examples?|bench|benches|benchmarks?)/|(^|/)conftest\.py$|(^|/)test_[^/]*$|_test\.(py|rs|go)$|\.spec\.(ts|tsx|js|jsx)$"
# Fields in which a literal is looked for; the first that has it counts.
LEXICAL_FIELDS = ("name", "signature", "file", "language", "role")
# The confidence of each way in which a relation was resolved.
LADDER = ((1.0, "exact"), (0.95, "type_inferred"), (0.9, "import_scoped"), (0.8, "receiver_guess"), (0.5, "name_only"), (0.3, "derived"))


def select_entities(entities: DataFrame, kinds=None, roles=None, languages=None, file=None, name=None) -> DataFrame:
    """Entities that pass every filter given."""
    for column, values in (("kind", kinds), ("role", roles), ("language", languages)):
        if values:
            entities = entities.where(F.col(column).isin(*values))
    if file is not None:
        entities = entities.where(F.col("file") == file)
    if name is not None:
        entities = entities.where(name_matches(F.col("name"), name))
    return entities


def name_matches(name: Column, pattern: str) -> Column:
    """`*x`: ends with x; `x*`: begins with x; else contains; letter case aside."""
    name, p = F.lower(name), pattern.lower()
    if p.startswith("*"):
        return name.endswith(p[1:])
    if p.endswith("*"):
        return name.startswith(p[:-1])
    return name.contains(p)


def tokens(text: Column) -> Column:
    """Lower-cased words of a name or path: cut at other characters than letters and digits, and in camelCase."""
    parted = F.regexp_replace(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(parted), "[^a-z0-9]+"), lambda t: t != "")


def by_all_tokens(entities: DataFrame, pattern: str, column: str = "name") -> DataFrame:
    """Entities whose tokens hold all tokens of the pattern."""
    spark = entities.sparkSession
    wanted = [r[0] for r in spark.range(1).select(F.explode(F.array_distinct(tokens(F.lit(pattern))))).collect()]  # the pattern's own words
    if not wanted:
        return entities.where(F.lit(False))
    return entities.where(F.size(F.array_intersect(tokens(F.col(column)), F.array(*map(F.lit, wanted)))) == len(wanted))


def by_name_tiers(entities: DataFrame, pattern: str, most: int = 32) -> DataFrame:
    """Exact names (tier 1) and entities with all tokens if those are `most` at most (tier 2); only without either, substrings (tier 3)."""
    exact = entities.where(F.lower("name") == pattern.lower()).withColumn("tier", F.lit(1))
    word = by_all_tokens(entities, pattern).where(F.lower("name") != pattern.lower())
    if most:
        few = word.agg(F.count("*").alias("hits")).where(F.col("hits") <= most).select(F.lit(2).alias("tier"))
        word = word.join(F.broadcast(few))  # one row or none
    part = entities.where(F.lower("name").contains(pattern.lower())).withColumn("tier", F.lit(3))
    found = exact.unionByName(word)
    none = found.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(True).alias("none"))
    return found.unionByName(part.join(F.broadcast(none)).drop("none"))  # the right side is one row or none


def page(rows: DataFrame, order: list, limit: int, offset: int) -> DataFrame:
    """Rows offset .. offset + limit of an order, with the total and where the next page begins."""
    total = rows.agg(F.count("*").alias("total"))
    got = rows.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))  # one row
    return got.withColumn("next_offset", F.when(F.col("total") > offset + limit, F.lit(offset + limit)).cast("long"))


# The fields of a whole entity in which a literal is looked for, in this order.
WHOLE_FIELDS = ("name", "signature", "doc_summary", "body_preview", "file_import_context", "file_surface_context")


def lexical_lookup(entities: DataFrame, literal: str, limit: int = 20, around: int = 80, fields=LEXICAL_FIELDS) -> DataFrame:
    """Entities in which a literal occurs, letter case aside: the first field that has it and an excerpt around it. Of modules and packages only name and signature count."""
    literal = literal.lower()
    inside = lambda f: F.coalesce(F.instr(F.lower(F.col(f)), literal) > 0, F.lit(False)) & ((F.lit(f in ("name", "signature"))) | ~F.col("kind").isin("Module", "Package"))
    field, text = F.lit(None).cast("string"), F.lit(None).cast("string")
    for f in reversed(fields):
        field, text = F.when(inside(f), F.lit(f)).otherwise(field), F.when(inside(f), F.col(f)).otherwise(text)
    hit = entities.withColumn("field", field).withColumn("text", text).where("field is not null")
    at = F.instr(F.lower("text"), literal)
    excerpt = F.substring("text", F.greatest(at - around, F.lit(1)), F.least(at - 1, F.lit(around)) + len(literal) + around)
    return hit.withColumn("excerpt", excerpt).orderBy("id").limit(min(limit, 100)).select("id", "field", "excerpt")


def impact_relations(relations: DataFrame) -> DataFrame:
    """Relations along which a change of dst reaches src, but for a declaring parent's own, unless it calls."""
    declared = relations.where("kind = 'Contains'").select("src", "dst").distinct()
    return relations.where(F.col("kind").isin(*IMPACT_KINDS) & (F.col("kind") != "Calls")).join(declared, ["src", "dst"], "left_anti").unionByName(relations.where("kind = 'Calls'").select("src", "dst", *[c for c in relations.columns if c not in ("src", "dst")]))


def impact_steps(relations: DataFrame) -> DataFrame:
    """(a, b) of stored relations (kind, src, dst): from what changes to what that can break, as impact_relations has them.

    Only relations of a declaring parent meet the declarations; the others aren't shuffled for that.
    """
    declared = relations.where("kind = 'Contains'").select("src", "dst").distinct()
    parents = cut(declared.select("src").distinct())
    some = relations.where(F.col("kind").isin(*IMPACT_KINDS) & (F.col("kind") != "Calls")).select("src", "dst")
    own = some.join(parents, "src", "left_semi").join(declared, ["src", "dst"], "left_anti").select("src", "dst")
    every = own.unionByName(some.join(parents, "src", "left_anti")).unionByName(relations.where("kind = 'Calls'").select("src", "dst"))
    return every.select(F.col("dst").alias("a"), F.col("src").alias("b"))


def nonproduction(file: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.lower(file), r"\\", "/").rlike(NONPRODUCTION), F.lit(False))


def dead_code_candidates(entities: DataFrame) -> DataFrame:
    magic = (F.col("kind") == "Method") & F.col("name").rlike(r"(^|\.)__[^.]*__$")
    return entities.where(F.col("kind").isin(*CODE_KINDS) & ~nonproduction(F.col("file")) & ~magic)


def api_surface(entities: DataFrame) -> DataFrame:
    return entities.where("visibility = 'Public' and role = 'Source' and kind not in ('File', 'DocumentNode', 'Test')")


def resolution(origin: Column, confidence: Column) -> Column:
    """How a relation was resolved: by its origin, else by the ladder of confidences, else by thresholds."""
    by_value = F.when(F.lit(False), "")
    for value, name in LADDER:
        by_value = by_value.when(F.round(confidence, 2) == value, name)
    by_value = by_value.when(confidence >= 0.95, "type_inferred").when(confidence >= 0.8, "receiver_guess").otherwise("name_only")
    return F.when(origin == "Lsp", "language_server").when(origin == "Manual", "manual").otherwise(by_value)


def capped_confidence(relations: DataFrame, derived: DataFrame, cap: float = 0.3) -> DataFrame:
    """Relations with an end in derived (id): confidence at most the cap, origin Inferred."""
    ids = derived.select(F.col("id").alias("d")).distinct().withColumn("hit", F.lit(True))
    a = ids.select(F.col("d").alias("src"), F.col("hit").alias("src_hit"))
    b = ids.select(F.col("d").alias("dst"), F.col("hit").alias("dst_hit"))
    hit = F.coalesce("src_hit", "dst_hit", F.lit(False))
    out = relations.join(a, "src", "left").join(b, "dst", "left")
    return out.withColumn("confidence", F.when(hit, F.least("confidence", F.lit(cap))).otherwise(F.col("confidence"))).withColumn("origin", F.when(hit, "Inferred").otherwise(F.col("origin"))).select(*relations.columns)


def scope_within(inner: Column, outer: Column) -> Column:
    """Whether a scope path (array of names) lies in another."""
    return F.slice(inner, 1, F.greatest(F.size(outer), F.lit(1))) == outer


def collisions(intents: DataFrame) -> DataFrame:
    """intents (intent, session, scope, lock): for each the strongest lock of other sessions on its scopes, hard or soft, and how often it meets their intents.

    Counts of a scope and of each session in it tell both without pairing the intents of a scope.
    """
    own = intents.groupBy("scope", "session").agg(F.count("*").alias("n"), F.count(F.when(F.col("lock") == "hard", 1)).alias("hard"))
    all_ = own.groupBy("scope").agg(F.sum("n").alias("all_n"), F.sum("hard").alias("all_hard"))
    met = intents.select("intent", "session", "scope").join(own, ["scope", "session"]).join(all_, "scope").where("all_n > n")
    return met.groupBy("intent").agg(F.when(F.max(F.col("all_hard") - F.col("hard")) > 0, "blocked").otherwise("warned").alias("outcome"), F.sum(F.col("all_n") - F.col("n")).alias("others"))


def audit(log: DataFrame, actor: str | None = None, action: str | None = None, since: str | None = None, limit: int | None = None, scope: str | None = None) -> DataFrame:
    """log (id, actor, action, at, scope): an actor ending in * is a prefix; action and scope are contained, events without a scope have none; since compares as text."""
    if actor:
        log = log.where(F.col("actor").startswith(actor[:-1]) if actor.endswith("*") else F.col("actor") == actor)
    if action:
        log = log.where(F.col("action").contains(action))
    if since:
        log = log.where(F.col("at") >= since)
    if scope:
        log = log.where(F.col("scope").contains(scope))
    return log.orderBy(F.desc("at"), F.desc("id")).limit(limit) if limit else log


def bare(name: Column) -> Column:
    """What follows the last `.` or `::`."""
    return F.regexp_extract(name, r"([^:.]*)$", 1)


def dotted(file: Column) -> Column:
    """A path as a module: separators to dots, without its extension; a package's __init__ is the package."""
    path = F.regexp_replace(F.regexp_replace(F.translate(file, "\\", "/"), r"\.[^./]*$", ""), "/", ".")
    return F.regexp_replace(path, r"\.__init__$", "")


# Names that a file's launch runs.
LAUNCHED = ("main", "__main__", "Main")


def entry_points(entities: DataFrame, declared: DataFrame) -> DataFrame:
    """Entities (id) that a manifest declares: declared (symbol, module, file).

    A symbol names an entity of its name, or of its last part if either is qualified; without one only a conventional entry
    point is meant. The module must name the entity's file (whole, or its end at a dot), or else the file must (whole, or
    its end at a slash); a declaration with neither binds nothing. Rows meet by equal values alone: each side has a row for
    each way in which it may be named and for each end of its path.
    """
    name = F.col("name")
    way = lambda how, what: F.concat(F.lit(how + ":"), what)
    only = lambda *ways: F.filter(F.array(*ways), lambda w: w.isNotNull())
    qualified, leaf = name.contains(".") | name.contains("::"), bare(name)
    names = only(way("whole", name), F.when(qualified, way("leaf of qualified", leaf)).otherwise(way("leaf", leaf)), F.when(leaf.isin(*LAUNCHED), way("launched", F.lit(""))))
    e = entities.where("file is not null and name is not null").repartition("id").select("id", F.explode(names).alias("called"), dotted(F.col("file")).alias("module"), F.translate("file", "\\", "/").alias("file"))
    end = lambda c, sep: e.select("id", "called", c, F.explode(F.sequence(F.lit(1), F.length(c) - F.length(F.translate(c, sep, "")) + 1)).alias("n")).select("id", "called", way(c, F.expr(f"substring_index({c}, '{sep}', -n)")).alias("place"))
    e = end("module", ".").unionByName(end("file", "/"))
    d = declared.select("symbol", F.nullif(F.trim(F.regexp_replace(F.trim("module"), r"^\.+|\.+$", "")), F.lit("")).alias("module"), F.nullif(F.regexp_replace(F.translate(F.trim("file"), "\\", "/"), r"^(\./)+", ""), F.lit("")).alias("declared"))
    d = d.where("module is not null or declared is not null")
    symbol = F.col("symbol")
    ways = F.when(symbol.isNull(), F.array(way("launched", F.lit("")))).otherwise(only(way("whole", symbol), way("leaf of qualified", bare(symbol)), F.when(symbol.contains("."), way("leaf", bare(symbol)))))
    d = d.select(F.explode(ways).alias("called"), F.when(F.col("module").isNotNull(), way("module", F.col("module"))).otherwise(way("file", F.col("declared"))).alias("place")).distinct()
    return e.join(d, ["called", "place"], "left_semi").select("id").distinct()


def unresolved_imports(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(id, src, dst, imported, source) of relations (id, kind, src, dst, import_source, token) into what isn't defined here.

    Calls and References count if their source is known, they say where they import from, and the last part of their token
    is an identifier. A target is foreign if nobody knows it, or if its role is External and it has no file.
    """
    local = entities.where("role <> 'External' or file is not null").select(F.col("id").alias("dst"))
    rows = relations.where(F.col("kind").isin("Calls", "References") & (F.coalesce("import_source", F.lit("")) != ""))
    rows = rows.withColumn("imported", F.trim(bare(F.col("token")))).where(F.col("imported").rlike(r"^[\p{L}\p{N}_]+$"))
    return rows.join(local, "dst", "left_anti").join(entities.select(F.col("id").alias("src")), "src", "left_semi").select("id", "src", "dst", "imported", F.col("import_source").alias("source"))


def satisfied(required: DataFrame, offered: DataFrame) -> DataFrame:
    """(interface, class, members): classes (class, member, arity) that offer every member of an interface (interface, member, arity) with its arity; an interface without members is satisfied by none.

    Interfaces that need the same are decided as one, and what is counted is classes by distinct needs; the result is
    spread to interfaces last, by a join whose rows no later step shuffles. What is offered is shuffled once, by class.
    """
    need = required.select("interface", F.struct("member", "arity").alias("one")).groupBy("interface").agg(F.array_sort(F.collect_set("one")).alias("all"))
    first = need.groupBy("all").agg(F.min("interface").alias("need"))
    each = cut(first.select("need", F.size("all").alias("n"), F.explode("all").alias("one")).select("need", "n", "one.*"))
    spread = cut(need.join(first, "all").select("interface", "need"))
    got = dealt(offered, "class").distinct().join(each, ["member", "arity"]).groupBy("class", "need").agg(F.count("*").alias("members"), F.first("n").alias("n")).where("members = n")
    return got.join(spread, "need").select("interface", "class", "members")

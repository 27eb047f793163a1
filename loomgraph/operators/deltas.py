"""Deltas of many tables at once: computed, validated as one state transition, applied all or not at all; merges by field."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import Store


@dataclass(frozen=True)
class Table:
    """key: its rows' identity (None: a bag of rows); strict: additions must be new and removals must be there; unique:
    columns whose values no two rows share; refs: columns that must name a row of another table."""

    key: str | None = None
    strict: bool = False
    unique: tuple[str, ...] = ()
    refs: dict[str, str] = field(default_factory=dict)


class Invalid(ValueError):
    """A delta that breaks its tables; nothing of it was applied."""


def same(a: DataFrame, b: DataFrame, columns: list[str]):
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in columns])


def delta_of(old: DataFrame, new: DataFrame, table: Table) -> DataFrame:
    """The rows to remove, add or modify, with op; of a keyed table a removed row is its old one."""
    columns = old.columns
    if table.key is None:
        gone = old.distinct().alias("x").join(new.distinct().alias("y"), same(old, new, columns), "left_anti").withColumn("op", F.lit("removed"))
        return gone.unionByName(new.distinct().alias("y").join(old.distinct().alias("x"), same(new, old, columns), "left_anti").withColumn("op", F.lit("added")))
    a, b = old.select(table.key, F.struct(*columns).alias("a")), new.select(table.key, F.struct(*columns).alias("b"))
    op = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "modified")
    rows = a.join(b, table.key, "full_outer").withColumn("op", op).where("op is not null")
    return rows.select(F.coalesce("b", "a").alias("r"), "op").select("r.*", "op")


def graph_delta(old: dict[str, DataFrame], new: dict[str, DataFrame], schema: dict[str, Table]) -> dict[str, DataFrame]:
    return {name: delta_of(old[name], new[name], t) for name, t in schema.items()}


def after(state: DataFrame, delta: DataFrame, table: Table) -> DataFrame:
    """Removed rows leave, then added and modified ones come."""
    come = delta.where("op <> 'removed'").select(*state.columns)
    if table.key is None:
        gone = delta.where("op = 'removed'").select(*state.columns).distinct()
        return state.join(gone, same(state, gone, state.columns), "left_anti").unionByName(come)
    return state.join(delta.select(table.key).distinct(), table.key, "left_anti").unionByName(come)


def problems(state: dict[str, DataFrame], deltas: dict[str, DataFrame], schema: dict[str, Table]) -> DataFrame:
    """(table, problem, subject) of a delta: what keeps it from being applied.

    repeated: a key with several rows in the delta; added_present and removed_absent in strict tables; not_unique: a value
    that several rows would share; dangling: a reference to a row that wouldn't be there.
    """
    out = None
    then = {name: after(state[name], deltas[name], t) for name, t in schema.items()}

    def found(name, problem, subjects):
        nonlocal out
        rows = subjects.select(F.lit(name).alias("table"), F.lit(problem).alias("problem"), subjects[subjects.columns[0]].cast("string").alias("subject")).distinct()
        out = rows if out is None else out.unionByName(rows)

    for name, t in schema.items():
        if t.key is not None:
            keys = deltas[name].select(t.key, "op")
            found(name, "repeated", keys.groupBy(t.key).count().where("count > 1").select(t.key))
            if t.strict:
                found(name, "added_present", keys.where("op = 'added'").join(state[name], t.key, "left_semi").select(t.key))
                found(name, "removed_absent", keys.where("op <> 'added'").join(state[name], t.key, "left_anti").select(t.key))
        for c in t.unique:
            found(name, "not_unique", then[name].where(F.col(c).isNotNull()).groupBy(c).count().where("count > 1").select(c))
        for c, other in t.refs.items():
            keys = then[other].select(F.col(schema[other].key).alias(c)).distinct()
            found(name, "dangling", then[name].where(F.col(c).isNotNull()).select(c).distinct().join(keys, c, "left_anti"))
    return out


def applied(state: dict[str, DataFrame], deltas: dict[str, DataFrame], schema: dict[str, Table]) -> dict[str, DataFrame]:
    """All tables after a delta, or Invalid."""
    wrong = problems(state, deltas, schema).orderBy("table", "problem", "subject").limit(5).collect()
    if wrong:
        raise Invalid("; ".join(f"{r.table}: {r.problem} {r.subject}" for r in wrong))
    return {name: after(state[name], deltas[name], t) for name, t in schema.items()}


def commit(store: Store, state: dict[str, DataFrame], deltas: dict[str, DataFrame], schema: dict[str, Table], expected: int) -> dict[str, DataFrame]:
    """Writes all tables after a delta and publishes them as one generation of a store; an invalid delta or another writer leaves everything as it was."""
    folder = f"tables-{uuid.uuid4().hex}"
    for name, df in applied(state, deltas, schema).items():
        df.write.parquet(f"{store.path}/data/{folder}/{name}")
    store.publish(folder, expected)
    return tables(store, {name: df.schema for name, df in state.items()})


def tables(store: Store, schemas: dict) -> dict[str, DataFrame]:
    """The tables of a store's newest generation."""
    folder = store.marks()[store.generation()]
    return {name: store.spark.read.schema(s).parquet(f"{store.path}/data/{folder}/{name}") for name, s in schemas.items()}


def merge_fields(base: DataFrame, ours: DataFrame, theirs: DataFrame, key: str, fields: list[str], signature: str = "signature", visibility: str = "visibility") -> DataFrame:
    """(key, fields, kind, conflicts, signature_change, visibility_change): rows of three states merged field by field.

    A field takes the side that changed it. kind: untouched, ours or theirs (one side changed), convergent (both made the same
    row), composed (they changed different fields, or some alike), divergent (a field changed in two ways; conflicts names
    them, and it keeps the base's value), add_add (both added, differently), modify_delete; rows that one side removed and the
    other left alone, or that both removed, are gone. signature_change and visibility_change (from>to) tell where the two
    sides' rows differ in these.
    """
    side = lambda df, n: df.select(key, F.struct(*fields).alias(n))
    rows = side(base, "o").join(side(ours, "a"), key, "full_outer").join(side(theirs, "b"), key, "full_outer")
    o, a, b = F.col("o"), F.col("a"), F.col("b")
    differ = lambda x, y, f: ~x[f].eqNullSafe(y[f])
    clash = F.filter(F.array(*[F.when(differ(a, o, f) & differ(b, o, f) & differ(a, b, f), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    both = o.isNotNull() & a.isNotNull() & b.isNotNull()
    kind = (
        F.when(both, F.when(a.eqNullSafe(o) & b.eqNullSafe(o), "untouched").when(b.eqNullSafe(o), "ours").when(a.eqNullSafe(o), "theirs").when(a.eqNullSafe(b), "convergent").when(F.size(clash) > 0, "divergent").otherwise("composed"))
        .when(o.isNull(), F.when(b.isNull(), "ours").when(a.isNull(), "theirs").when(a.eqNullSafe(b), "convergent").otherwise("add_add"))
        .when(a.isNull() & b.isNull(), "gone").when(a.isNull(), F.when(b.eqNullSafe(o), "gone").otherwise("modify_delete")).otherwise(F.when(a.eqNullSafe(o), "gone").otherwise("modify_delete"))
    )
    value = lambda f: F.when(both, F.when(~differ(a, o, f), b[f]).when(~differ(b, o, f) | ~differ(a, b, f), a[f]).otherwise(o[f])).otherwise(F.coalesce(a[f], b[f]))
    conflicts = F.when(both, F.array_join(clash, ",")).otherwise("")
    seen = F.col("a").isNotNull() & F.col("b").isNotNull()
    merged = rows.withColumn("kind", kind).withColumn("conflicts", conflicts)
    return merged.where("kind <> 'gone'").select(
        key, *[value(f).alias(f) for f in fields], "kind", "conflicts", F.coalesce(seen & differ(a, b, signature), F.lit(False)).alias("signature_change"),
        F.when(seen & differ(a, b, visibility), F.concat_ws(">", a[visibility], b[visibility])).alias("visibility_change"),
    )

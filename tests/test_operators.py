"""Small hand-made cases of the graph, history and store operators."""

import uuid

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S
from loomgraph.operators import filters as fl
from loomgraph.operators import graph as g
from loomgraph.operators import history as h
from loomgraph.operators import retrieval as rt
from loomgraph.operators import review as rv
from loomgraph.operators import stats as st
from loomgraph.sources.store import Conflict, Store, checkpoint_dir
from loomgraph.streaming import feed

REL = "id string, kind string, src string, dst string, confidence double, origin string, evidence long"
ENT = "id string, kind string, name string, file string, role string"


def edges(spark, pairs, kind="Calls"):
    return spark.createDataFrame([(f"{a}{b}", kind, a, b, 1.0, "Parsed", 1) for a, b in pairs], REL)


def nodes(spark, ids):
    return spark.createDataFrame([(i, "Function", i, f"{i}.py", "Source") for i in ids], ENT)


def test_neighbourhood_lists_edges_of_expanded_nodes_only(spark):
    e, r = nodes(spark, "abc"), edges(spark, ["ab", "bc", "ca", "ax"])
    got, rel = g.neighbourhood(spark.createDataFrame([("a",), ("unknown",)], "id string"), e, r, 1)
    assert {(x.node, x.hop) for x in got.collect()} == {("a", 0), ("b", 1)}  # x is no entity
    assert {x.id for x in rel.collect()} == {"ab", "ax"}


def test_downstream_leaves_out_the_start_even_in_a_cycle(spark):
    got = g.downstream(spark.createDataFrame([("a",)], "id string"), nodes(spark, "abc"), edges(spark, ["ab", "bc", "ca"]), 5)
    assert {(x.node, x.hop) for x in got.collect()} == {("c", 1), ("b", 2)}


def test_impact_drops_declaring_parents_unless_they_call(spark):
    r = edges(spark, ["pm"], "Contains").unionByName(edges(spark, ["pm"], "UsesType")).unionByName(edges(spark, ["pm"], "Calls"))
    assert {x.kind for x in fl.impact_relations(r).collect()} == {"Calls"}


def test_two_entities_without_a_file_share_one(spark):
    e = spark.createDataFrame([("a", "Function", "a", None, "Source"), ("b", "Function", "b", None, "Source"), ("c", "Function", "c", "c.py", "Source")], ENT)
    dead = g.dead_code(fl.dead_code_candidates(e), e, edges(spark, ["ab", "ac", "zb"]))
    assert {x.id for x in dead.collect()} == {"a", "b"}


def test_routes(spark):
    r = edges(spark, ["ab", "bd", "ac", "cd", "de"])
    pairs = spark.createDataFrame([("a", "d"), ("e", "a")], "root string, goal string")
    assert [(x.hops, x.path) for x in g.routes(pairs, r, 3).orderBy("path").collect()] == [(2, "a>b>d"), (2, "a>c>d")]


def test_net_effect(spark):
    log = [(1, "x", "added", 1), (2, "x", "removed", 1), (1, "y", "removed", 1), (2, "y", "added", 2), (1, "z", "modified", 5), (2, "z", "removed", 5), (1, "w", "added", 1), (2, "w", "modified", 3)]
    got = h.net_effect(spark.createDataFrame(log, "ord long, entity string, op string, value long"))
    assert {(r.entity, r.op, r.new, r.old) for r in got.collect()} == {("y", "added", 2, None), ("z", "removed", None, 5), ("w", "added", 3, None)}


def test_interval_ends_before_its_end(spark):
    rev = spark.createDataFrame([("a", 1, 5), ("b", 5, None)], "entity string, introduced long, ended long")
    assert [x.entity for x in h.active_at(rev, 5).collect()] == ["b"]


def test_store_compare_and_swap(spark):
    store = Store(spark, f"{checkpoint_dir(spark)}/store-{uuid.uuid4().hex}")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    assert store.recover("id") is None
    assert store.save_snapshot(df, 0) == 1
    with pytest.raises(Conflict):
        store.save_snapshot(df, 0)
    assert store.save_delta(spark.createDataFrame([(2, "b", "removed"), (3, "c", "added")], "id long, v string, op string"), 1) == 2
    assert {tuple(r) for r in store.recover("id").collect()} == {(1, "a"), (3, "c")}
    with pytest.raises(Conflict):
        store.clear_deltas()
    store.save_snapshot(store.recover("id"), 2)
    store.clear_deltas()
    assert store.deltas(0) is None and {tuple(r) for r in store.recover("id").collect()} == {(1, "a"), (3, "c")}


def test_store_keeps_the_winner_of_two_writers_and_survives_crashes(spark):
    path = f"{checkpoint_dir(spark)}/store-{uuid.uuid4().hex}"
    rows = lambda v: spark.createDataFrame([(1, v)], "id long, v string")
    one, two = Store(spark, path), Store(spark, path)
    two.generation = lambda: 0  # it looked before the other was done
    assert one.save_snapshot(rows("winner"), 0) == 1
    with pytest.raises(Conflict):
        two.save_snapshot(rows("loser"), 0)
    assert [r.v for r in one.recover("id").collect()] == ["winner"] and one.marks().keys() == {1}
    # a writer dies with its files written and no marker
    rows("dead").write.parquet(f"{path}/data/snapshot-dead")
    assert one.save_snapshot(rows("second"), 1) == 2
    # and one dies between a marker's creation and its content: it doesn't count, and is taken over once it is stale
    one._fs.create(one._path(f"{path}/marks/3"), False).close()
    assert one.generation() == 2 and [r.v for r in one.recover("id").collect()] == ["second"]
    with pytest.raises(Conflict):
        one.save_snapshot(rows("third"), 2)
    assert Store(spark, path, stale_s=0).save_snapshot(rows("third"), 2) == 3 and [r.v for r in one.recover("id").collect()] == ["third"]


def test_modules_of_paths(spark):
    cases = {"main.c": "(root)", "src/net.c": "src", "crates/kernel/src/graph.rs": "crates/kernel", "deps/hiredis/net.c": "deps", None: "(unknown)", "": "(unknown)", "src\\modules\\vector.c": "src/modules", "./src/net.c": "src", "tests/a/b.py": "tests", "services//api/x.go": "services/api"}
    df = spark.createDataFrame([(p, m) for p, m in cases.items()], "path string, want string")
    assert all(r.got == r.want for r in df.select("want", S.module_of(F.col("path")).alias("got")).collect())


def test_tiers_of_files(spark):
    from loomgraph.operators import artifacts as art

    cases = {"a/b.tsx": "semantic", "x.tfvars": "semantic", "pom.xml": "structured", "a/Gemfile": "structured", "Dockerfile.dev": "structured", ".github/workflows/ci.yml": "structured", "db/Migrations/1.sql": "structured", "q.sql": "opaque", "readme.md": "opaque", "GNUmakefile": "structured", "bin/tool": "opaque"}
    df = spark.createDataFrame([(p, m) for p, m in cases.items()], "path string, want string")
    assert all(r.got == r.want for r in df.select("want", art.tier(F.col("path")).alias("got")).collect())


def test_question_tokens(spark):
    row = spark.range(1).select(S.question_tokens(F.lit("How does my io module get the new type of a db?")).alias("t")).first()
    assert row.t == ["io", "module", "get", "new", "type", "db"]


def test_collisions_without_pairs(spark):
    i = spark.createDataFrame([(1, "a", "x", "soft"), (2, "b", "x", "hard"), (3, "a", "x", "soft"), (4, "c", "y", "hard"), (2, "b", "z", "hard"), (5, "d", "z", "soft")], "intent long, session string, scope string, lock string")
    assert {tuple(r) for r in fl.collisions(i).collect()} == {(1, "blocked", 1), (3, "blocked", 1), (2, "warned", 3), (5, "blocked", 1)}


def test_digest_counts_equal_rows(spark):
    one = spark.createDataFrame([(1, "a")], "id long, v string")
    assert st.digest(one.unionByName(one).unionByName(one)).first() != st.digest(one).first()


def test_security_findings(spark):
    from loomgraph.operators import review as rv

    ents = [("api", "ApiEndpoint", "Private"), ("api2", "ApiEndpoint", "Private"), ("f", "Function", "Public"), ("g", "Function", "Public"), ("h", "Function", "Private"), ("ev", "EventContract", "Private"), ("ev2", "EventContract", "Private"), ("hub", "Class", "Public")]
    ents += [(f"u{i}", "Class", "Private") for i in range(21)]
    rels = [("1", "Tests", "t", "api2"), ("2", "Calls", "f", "h"), ("3", "Calls", "h", "g"), ("4", "ConsumesContract", "f", "ev2"), ("5", "ConsumesContract", "ev", "ev")] + [(f"r{i}", "UsesType", f"u{i}", "hub") for i in range(21)]
    e, r = spark.createDataFrame(ents, "id string, kind string, visibility string"), spark.createDataFrame(rels, "id string, kind string, src string, dst string")
    got = {tuple(x) for x in rv.security_findings(e, r, propagate=False).collect()}
    assert got == {("high", "untested-api", "api", 1), ("low", "orphaned-public", "f", 1), ("medium", "high-fan-out", "hub", 21), ("medium", "dead-event", "ev", 1), ("low", "encapsulation-leak", "f", 1)}
    more = {tuple(x) for x in rv.security_findings(e, r).collect()} - got
    assert more == {("info", "transitive-dependency", f"u{i}", 1) for i in range(21)}


def test_security_findings_count_all(spark):
    ents = [("hub", "Class", "Public"), ("hub2", "Class", "Public")] + [(f"u{i}", "Class", "Private") for i in range(25)]
    rels = [(f"{hub}{i}", "UsesType", f"u{i}", hub) for i in range(25) for hub in ("hub", "hub2")]
    e, r = spark.createDataFrame(ents, "id string, kind string, visibility string"), spark.createDataFrame(rels, "id string, kind string, src string, dst string")
    want = {("medium", "high-fan-out", h, 25) for h in ("hub", "hub2")} | {("info", "transitive-dependency", f"u{i}", 2) for i in range(25)}
    assert {tuple(x) for x in rv.security_findings(e, r).collect()} == want


def test_security_findings_store_no_pairs_of_roots_with_ends(spark, monkeypatch):
    from loomgraph.operators import review as rv

    ents = [("hub", "Class", "Public"), ("hub2", "Class", "Public")] + [(f"u{i}", "Class", "Private") for i in range(25)]
    rels = [(f"{hub}{i}", "UsesType", f"u{i}", hub) for i in range(25) for hub in ("hub", "hub2")]
    e, r = spark.createDataFrame(ents, "id string, kind string, visibility string"), spark.createDataFrame(rels, "id string, kind string, src string, dst string")
    pairs, cut = [], g.cut

    def counted(df, path=None):
        got = cut(df, path)
        pairs.extend([got.count()] if "root" in got.columns and "node" in got.columns else [])
        return got

    monkeypatch.setattr(g, "cut", counted)
    assert rv.security_findings(e, r).count() == 27
    assert sum(pairs) == 0  # their edges tell it


def test_dependents_equal_all_pairs(spark):
    import random

    rng = random.Random(7)
    for n, tails in ((30, 25), (12, 60)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(n + 5)] + [(rng.randrange(n), 100 + rng.randrange(tails)) for _ in range(2 * tails)] + [(3, 3), (4, None), (5, None), (None, 6)]
        df = spark.createDataFrame(edges + edges[:9], "a long, b long")
        to = {}
        for a, b in edges:
            to.setdefault(a, set()).add(b)

        def hops(root, depth):
            seen, level = {root}, {root}
            for _ in range(depth):
                level = {b for a in level if a is not None for b in to.get(a, ())} - seen
                seen |= level
            return seen - {root}

        every, some = set(range(0, n + 9)), set(range(0, n, 3)) | {101}
        for most, depth in ((1, 1), (5, 2), (5, 5)):
            d = g.Dependents(df, spark.createDataFrame([(i,) for i in every], "id long"), most)
            got = {x.id: x.n for x in d.of_roots(depth).collect()}
            assert got == {i: len(hops(i, depth)) for i in every if hops(i, depth)}
            want = {}
            for i in some:
                for b in hops(i, depth):
                    want[b] = want.get(b, 0) + 1
            assert {x.id: x.n for x in d.of_nodes(spark.createDataFrame([(i,) for i in some], "id long"), depth).collect()} == want


def test_numbers_stand_for_ids(spark, sf_dir):
    from loomgraph.plans.model import entities, named, numbered

    ids = entities(spark, sf_dir).select("id", numbered("id").alias("n")).select("id", "n", named("n").alias("again"))
    assert ids.where("id <> again or again is null").count() == 0 and ids.select("n").distinct().count() == ids.count()
    assert spark.sql("SELECT 'o:-5' AS id").select(numbered("id").alias("n")).select(named("n")).first()[0] == "o:-5"


def test_name_tiers_fall_back_to_substrings(spark):
    e = nodes(spark, ["fooBar", "barFoo", "xfoobarx"])
    tiers = lambda p: {(r.id, r.tier) for r in fl.by_name_tiers(e, p).collect()}
    assert tiers("fooBar") == {("fooBar", 1), ("barFoo", 2)}
    assert tiers("oobarx") == {("xfoobarx", 3)}


def test_scalars(spark):
    row = spark.range(1).select(S.strip_generics(F.lit("Map<K, Vec<V>>::get")).alias("a"), S.leaf(F.lit("a::b.c")).alias("b"), S.qualifier(F.lit("a::b::c")).alias("c"), S.module_of(F.lit("src/io/x.py")).alias("d"), S.go_arity(F.lit("func f()")).alias("e"), S.cosine_distance(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("f"), S.code_tokens(F.lit("getUserById src/io/ascii/html.py")).alias("g"), S.token_estimate(F.lit("a b, c d e f")).alias("h")).first()
    assert tuple(row) == ("Map::get", "c", "a::b", "src/io", 0, 1.0, ["get", "user", "by", "id", "src", "io", "ascii", "html", "py"], 8)


def test_scores_of_single_signals(spark):
    rows = [("q", s, *[1.0 if n == s else 0.0 for n in rt.SIGNALS]) for s in rt.SIGNALS] + [("q", "all", *[1.0] * 5)]
    df = spark.createDataFrame(rows, "query string, id string, lexical double, semantic double, graph double, proof double, provenance double")
    assert {r.id: r.score for r in rt.rank_candidates(df).collect()} == {"lexical": 0.3, "semantic": 0.28, "graph": 0.18, "proof": 0.16, "provenance": 0.08, "all": 1.0}
    assert {r.id: r.score for r in rt.rank_candidates(df, proof=True).collect()}["proof"] == 0.216


def test_co_change_ignores_single_and_large_baskets(spark):
    b = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "a"), (3, "b"), (3, "c")] + [(4, str(i)) for i in range(30)], "change long, item string")
    got = {(r.a, r.b): (r.pairs, r.confidence) for r in st.co_change(b, hub=None).collect()}
    assert got[("a", "b")] == (2, 1.0) and got[("a", "c")] == (1, 0.5) and len(got) == 6


def test_feed_replica_is_idempotent(spark):
    rows = [(1, "a", "added", 1.0), (2, "b", "added", 2.0), (3, "a", "modified", 3.0), (4, "b", "removed", 0.0)]
    df = spark.createDataFrame(rows, "seq long, id string, type string, value double").withColumn("at", F.lit("2024-01-01").cast("timestamp_ntz"))
    state = feed.replicated(spark, df.where("seq <= 2"), df, 2)  # the feed overlaps the snapshot
    assert {(r.id, r.value) for r in state.collect()} == {("a", 3.0)}


def test_sessions_stream(spark):
    rows = [(1, "a", "x", 1.0, "2024-01-01 00:00:00"), (2, "a", "x", 2.0, "2024-01-01 00:01:00"), (3, "a", "x", 4.0, "2024-01-01 03:00:00"), (4, "b", "x", 0.0, "2024-01-02 00:00:00")]
    df = spark.createDataFrame(rows, "seq long, id string, type string, value double, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    out = feed.replayed(spark, df, 1, lambda s: feed.sessions(s, "10 minutes", "1 hour").select("id", "events", "value"))
    assert ("a", 2, 3.0) in {tuple(r) for r in out.collect()}


@pytest.mark.parametrize("n", [1, 2, 4, 5, 16, 17, 40])
def test_first_parents_of_chains_of_any_length(spark, n):
    changes = spark.createDataFrame([(i, i - 1 if i else None) for i in range(50)], "id long, parent long")
    got = h.first_parents(changes, spark.createDataFrame([(n - 1,)], "id long"))
    assert sorted(tuple(r) for r in got.collect()) == [(i, n - 1 - i) for i in range(n)]


@pytest.mark.parametrize("block", [7, 100])
def test_first_parents_from_block_to_block(spark, block, monkeypatch):
    import random

    rng = random.Random(3)
    ids = list(range(60))
    for near in (True, False):  # parents are near by id, or anywhere; the first names one that isn't recorded
        if not near:
            rng.shuffle(ids)
        parent = {ids[i]: ids[max(0, i - rng.choice((1, 1, 2)))] if i else 1000 for i in range(60)}
        want, at = [], ids[55]
        while at is not None:
            want.append((at, len(want)))
            at = parent.get(at)
        rounds, doubled = [], h._doubled
        monkeypatch.setattr(h, "_doubled", lambda ways, head: rounds.append(ways.count()) or doubled(ways, head))
        got = h.first_parents(spark.createDataFrame(list(parent.items()), "id long, parent long"), spark.createDataFrame([(ids[55],)], "id long"), block)
        assert sorted((r.back, r.change) for r in got.collect()) == [(b, c) for c, b in want]
        monkeypatch.undo()
        if near:  # only changes at the blocks' edges are left to doubling
            assert rounds[0] <= 3 * (60 // block + 1)


def test_first_parents_end_on_cycles(spark):
    with pytest.raises(Exception, match="own first parents"):
        h.first_parents(spark.createDataFrame([(1, 2), (2, 1)], "id long, parent long"), spark.createDataFrame([(1,)], "id long"))


def test_replay_prunes_relations_of_removed_entities(spark):
    chain = spark.createDataFrame([(i, 9 - i) for i in range(10) if i != 5], "change long, back long")
    e = [(0, "a", "added"), (1, "b", "added"), (2, "c", "added"), (4, "b", "removed"), (5, "c", "removed"), (6, "b", "added")]
    r = [(2, "ab", "a", "b", "added"), (3, "ac", "a", "c", "added"), (7, "bc", "b", "c", "added"), (8, "ax", "a", "x", "added"), (3, "cc", "c", "c", "added"), (8, "cc", "c", "c", "removed"), (4, "bb", "b", "b", "added")]
    alive, kept, dead = h.resolve_at(chain, spark.createDataFrame(e, "change long, id string, op string"), spark.createDataFrame(r, "change long, id string, src string, dst string, op string"))
    assert {tuple(x) for x in alive.collect()} == {("a", 0), ("b", 6), ("c", 2)}  # change 5 is on a branch
    assert {x.id for x in kept.collect()} == {"ac", "bc"}  # ab stays away when b returns, x isn't known
    assert {tuple(x) for x in dead.collect()} == {("relation", "ab", 4), ("relation", "bb", 4), ("relation", "cc", 8)}


def test_merge_divergences(spark):
    t = lambda rows: spark.createDataFrame(rows, "id string, value string")
    got = h.composed(t([("a", "1"), ("b", "1"), ("c", "1")]), t([("a", "2"), ("b", "1")]), t([("a", "1"), ("c", "3"), ("d", "2")]))
    assert {tuple(r) for r in got.collect()} == {("a", "take_ours", "2", True), ("b", "take_theirs", None, False), ("c", "removed_ours_changed_theirs", None, True), ("d", "take_theirs", "2", True)}
    paths = h.path_collisions(got.select("id", F.col("value").alias("path")))
    assert {tuple(r) for r in paths.collect()} == {("2", "a"), ("2", "d")}
    ends = h.dangling(edges(spark, ["ab", "aa", "xb"]), got.where("survives").select("id"))
    assert {tuple(r) for r in ends.collect()} == {("ab", "b"), ("xb", "x"), ("xb", "b")}


def test_traffic_takes_the_strongest_scope(spark):
    e = spark.createDataFrame([(i, "Function", i, f, "Source") for i, f in (("a", "f1"), ("b", "f2"), ("c", "f3"), ("s", "f1"), ("z", None))], ENT)
    r = edges(spark, ["ab", "bc", "as", "cx"], "Calls").unionByName(edges(spark, ["az"], "Contains"))
    rows = [(1, "entity", "a"), (2, "entity", "b"), (3, "entity", "c"), (4, "file", "f1"), (4, "file", "f3"), (5, "file", "f3"), (6, "entity", "z"), (7, "entity", "s"), (8, "file", "f2")]
    intents = spark.createDataFrame(rows, "intent long, kind string, scope string").withColumn("expires", F.lit(None).cast("date"))
    gone = spark.createDataFrame([(9, "entity", "a")], "intent long, kind string, scope string").withColumn("expires", F.lit("2020-01-01").cast("date"))
    got = g.traffic(spark.createDataFrame([("a",)], "id string"), e, r, intents.unionByName(gone), 3, F.lit("2024-01-01").cast("date"))
    want = {(1, "direct", 0), (2, "direct", 1), (3, "downstream", 2), (4, "same_file", 0), (5, "downstream", 2), (7, "direct", 1), (8, "direct", 1)}
    assert {(x.intent, x.proximity, x.distance) for x in got.collect()} == want


def test_traffic_without_budgets_looks_at_all(spark):
    e = spark.createDataFrame([(i, "Function", i, "f", "Source") for i in "abc"], ENT)
    r = edges(spark, ["ab", "ac"], "Calls")
    intents = spark.createDataFrame([(1, "entity", "b")], "intent long, kind string, scope string").withColumn("expires", F.lit(None).cast("date"))
    run = lambda **most: g.traffic(spark.createDataFrame([("a",)], "id string"), e, r, intents, 3, F.lit("2024-01-01").cast("date"), **most).collect()
    with pytest.raises(ValueError):
        run(edges=1)
    assert [(x.intent, x.proximity, x.distance) for x in run(nodes=None, edges=None)] == [(1, "direct", 1)]


def test_gate_decisions(spark):
    reviews = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (4, 1), (5, 0)], "review long, approvals long")
    findings = spark.createDataFrame([(3, False)] * 3 + [(4, False)] * 3 + [(5, True)], "review long, blocking boolean")
    assert {r.review: r.status for r in rv.decisions(reviews, findings).collect()} == {1: "pass", 2: "needs_attention", 3: "blocked", 4: "needs_attention", 5: "blocked"}


def test_next_removals_in_spans(spark):
    import random

    rng = random.Random(2)
    ends = [(rng.choice("ab"), -rng.randrange(60), i) for i in range(80)]
    gone = [(n, -t, 1000 + t) for n in "ab" for t in rng.sample(range(60), 8)]
    df = spark.createDataFrame(ends, "node string, at long, relation int"), spark.createDataFrame(gone, "node string, at long, change long")
    want = {r: min(((t, c) for m, t, c in gone if m == n and t >= at), default=None) for n, at, r in ends}
    for span in (1, 7, 1000):
        assert {r.relation: r.next and tuple(r.next) for r in h.next_removals(*df, span).collect()} == want


def test_release_check_names_what_blocks(spark):
    rows = [("a", 1, 1, None), ("b", 1, 2, 2), ("c", 1, None, 1)]
    branches = spark.createDataFrame(rows, "branch string, source long, head long, expected long")
    states = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 3), ("b", 4)], "branch string, id long")
    waiting = spark.createDataFrame([("b", 7)], "branch string, change long")
    check = lambda **k: {r.branch: r.blockers for r in rv.release_check(branches, states, waiting, **k).collect()}
    # nothing of a source is proven yet, and an empty one lacks nothing
    assert check() == {"a": "coverage", "b": "entity_count,coverage,branch_moved", "c": "entity_count,branch_gone"}
    assert check(force=True) == {"a": "", "b": "entity_count,branch_moved", "c": "entity_count,branch_gone"}
    assert check(proof=True, approval=True, force=True) == {"a": "proof", "b": "entity_count,proof,approval,branch_moved", "c": "entity_count,branch_gone"}
    assert {(r.branch, r.entities, r.covered, r.missing, r.share) for r in rv.release_coverage(branches, states).collect()} == {("a", 2, 0, 2, 0.0), ("b", 3, 0, 3, 0.0), ("c", 0, 0, 0, 1.0)}


def test_compare_refuses(spark):
    rows = [(1, None, None), (2, 1, None), (3, 1, None), (4, 2, 3), (5, 3, 2), (6, 4, None), (10, None, None), (11, 10, None)] + [(100 + i, 99 + i if i else None, None) for i in range(30)]
    changes = spark.createDataFrame(rows, "id long, parent long, merged long")
    pairs = spark.createDataFrame([("line", 2, 6), ("same", 6, 6), ("cross", 4, 5), ("apart", 6, 11), ("deep", 129, 101), ("back", 6, 1)], "pair string, base long, head long")
    got = {r["pair"]: tuple(r)[1:] for r in g.compare(pairs, changes, most=20).collect()}
    assert got == {"line": (3, 0, 2, 1, None), "same": (0, 0, 6, 1, None), "cross": (None, None, None, 2, "ambiguous_merge_base"), "apart": (None, None, None, 0, "no_common_ancestor"), "deep": (None, None, None, None, "history_too_deep"), "back": (0, 4, 1, 1, None)}
    assert g.reach(spark.createDataFrame([("r", 129)], "root string, node long"), changes.selectExpr("id as a", "parent as b").where("b is not null"), most=20).count() == 21


def test_spread_and_wide_equal_all_pairs(spark):
    import random

    rng = random.Random(4)
    edges = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(90)} | {(50, i) for i in range(50)} | {(59, 50)})
    df = spark.createDataFrame(edges, "a long, b long")
    ids = spark.createDataFrame([(i,) for i in range(60)], "id long")
    for depth, most in ((1, 3), (2, 5), (3, 20)):
        every = {(r.root, r.node): r.hop for r in g.reach(g.rooted(ids), df, depth).collect()}
        n = {i: sum(1 for (a, b) in every if a == i != b) for i in range(60)}
        assert {(r.root, r.n) for r in g.wide(ids, df, depth, most).collect()} == {(i, most + 1) for i in n if n[i] > most}
        for sources in ({1, 2, 3, 50}, set(range(0, 60, 3)), {7}):
            want = {}
            for (a, b), hop in every.items():
                if a in sources and a != b:
                    want[b] = min(hop, want.get(b, 99))
            assert {r.node: r.hop for r in g.spread(ids.where(ids.id.isin(*sources)), df, depth).collect()} == want


def test_impact_at_a_ref_follows_what_a_removal_severed(spark):
    alive = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    kept, severed = spark.createDataFrame([("c", "b"), ("d", "c")], "src string, dst string"), spark.createDataFrame([("b", "x"), ("y", "x"), ("d", "a")], "src string, dst string")
    starts = spark.createDataFrame([("x",), ("b",), ("a",)], "id string")
    got = {(r.root, r.node, r.hop) for r in g.impact_at(starts, alive, kept, severed, 2).collect()}
    assert got == {("x", "b", 1), ("x", "c", 2), ("b", "c", 1), ("b", "d", 2)}  # a is alive, so what was severed from it doesn't count


def test_severed_by_one_end(spark):
    ended = spark.createDataFrame([("1", "a", "x", 5), ("2", "x", "a", 5), ("3", "a", "x", 6)], "id string, src string, dst string, ended long")
    gone = spark.createDataFrame([("x", 5)], "node string, ended long")
    assert {r.id for r in h.severed(ended, gone, ("dst",)).collect()} == {"1"}
    assert {r.id for r in h.severed(ended, gone).collect()} == {"1", "2"}


def test_unapproved_needs_a_known_human(spark):
    changes = spark.createDataFrame([(0, None, "x"), (1, 0, "x"), (2, 1, "y"), (3, 2, "y")], "id long, parent long, author string")
    got = spark.createDataFrame([("h", i) for i in range(4)], "root string, node long")
    approvals = spark.createDataFrame([(1, "ann", "approved"), (2, "bot", "approved"), (2, "ann", "rejected"), (3, "who", "approved")], "change long, actor string, decision string")
    actors = spark.createDataFrame([("ann", "Human"), ("bot", "Agent")], "actor string, kind string")
    assert {r.change for r in rv.unapproved(got, changes, approvals, actors).collect()} == {2, 3}


def test_what_is_dealt_out_does_not_grow_with_the_input(spark, tmp_path, monkeypatch):
    from loomgraph.operators import stats as st
    from loomgraph.sources import store

    path = str(tmp_path / "some edges")
    edges(spark, ["ab", "bc", "cb", "ac", "ca", "aa"]).repartition(3).write.parquet(path)
    some = spark.read.parquet(path)
    assert store.rows_read(some.unionByName(some)) == 6 and store.rows_read(spark.range(3)) == 0
    monkeypatch.setattr(store, "TASK_ROWS", 2)
    parts = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for got, want in ((st.degrees(some), {("a", 2), ("b", 2), ("c", 2)}), (st.partners(some, "dst", "src", "n"), {("a", 2), ("b", 2), ("c", 2)}), (g.edges_of(some), {("a", "b"), ("b", "c"), ("c", "b"), ("a", "c"), ("c", "a"), ("a", "a")})):
        assert ", 3), REPARTITION_BY_NUM" in parts(got)
        assert {tuple(r) for r in got.select(got.columns[:2]).collect()} == want


def test_traversal_writes_each_relation_once(spark, monkeypatch):
    rows = [(f"{a}{b}", "Calls", "entity", a, "entity", b) for a, b in ("ab", "bc", "cd", "xa")]
    r = spark.createDataFrame(rows, "id string, kind string, src_kind string, src string, dst_kind string, dst string")
    written, cut = [], g.cut
    monkeypatch.setattr(g, "cut", lambda df, path=None: written.append(df.columns) or cut(df, path))
    found, touched = g.traverse(spark.createDataFrame([("entity", "a")], "kind string, id string"), r, spark.createDataFrame([("entity", x) for x in "abcd"], "kind string, id string"), 2)
    assert {(x.id, x.hop, x.known) for x in found.collect()} == {("a", 0, True), ("b", 1, True), ("c", 2, True), ("x", 1, False)}
    assert {x.relation for x in touched.collect()} == {"ab", "bc", "xa"}
    assert ["a", "b"] not in written and written.count(["id", "a", "b"]) == 1


def test_reach_from_relations_writes_each_once(spark, monkeypatch):
    r = spark.createDataFrame([("1", "Calls", "a", "b"), ("2", "Imports", "a", "b"), ("3", "Calls", "b", "c"), ("4", "Calls", "d", "c"), ("5", "Calls", "x", "a")], "id string, kind string, src string, dst string")
    e = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    written, cut = [], g.cut
    monkeypatch.setattr(g, "cut", lambda df, path=None: written.append(df.columns) or cut(df, path))
    seeds = spark.createDataFrame([("a",)], "id string")
    found, touched = g.expand(seeds, e, r, 2)
    assert {(x.node, x.hop) for x in found.collect()} == {("a", 0), ("b", 1), ("c", 2)} and {x.id for x in touched.collect()} == {"1", "2", "3", "5"}
    assert {(x.node, x.hop) for x in g.downstream(spark.createDataFrame([("c",)], "id string"), e, r, 2).collect()} == {("b", 1), ("d", 1), ("a", 2)}
    assert written.count(["src", "dst"]) == 2 and ["a", "b"] not in written  # one for each of the two calls

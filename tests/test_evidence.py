"""Deltas, merges, reverts, context packs, lookups and signals on hand-made cases."""

import uuid

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import context, deltas, reverts
from loomgraph.operators import filters as fl
from loomgraph.operators import graph as g
from loomgraph.operators import history as h
from loomgraph.operators import retrieval as rt
from loomgraph.operators import review as rv
from loomgraph.sources.store import Conflict, Store, checkpoint_dir

SCHEMA = {"nodes": deltas.Table("id", unique=("path",)), "edges": deltas.Table("id", strict=True, refs={"src": "nodes", "dst": "nodes"}), "notes": deltas.Table()}


def graph(spark, nodes, edges, notes):
    return {"nodes": spark.createDataFrame(nodes, "id long, path string"), "edges": spark.createDataFrame(edges, "id long, src long, dst long"), "notes": spark.createDataFrame(notes, "note string")}


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_one_bad_row_refuses_the_whole_delta(spark):
    old = graph(spark, [(1, "a"), (2, "b"), (3, None)], [(1, 1, 2), (2, 2, 3)], [("x",), ("x",), ("y",)])
    new = graph(spark, [(1, "c"), (2, "a"), (4, None)], [(1, 1, 2), (3, 4, 1)], [("y",), ("z",)])
    store = Store(spark, f"{checkpoint_dir(spark)}/tables-{uuid.uuid4().hex}")
    delta = deltas.graph_delta(old, new, SCHEMA)
    held = deltas.commit(store, old, delta, SCHEMA, 0)
    assert all(rows(held[n]) == rows(new[n]) for n in SCHEMA) and store.generation() == 1
    row = lambda name, *r: spark.createDataFrame([r], [*new[name].columns, "op"])
    bad = {
        "dangling": {"nodes": row("nodes", 4, "", "removed")}, "added_present": {"edges": row("edges", 1, 2, 1, "added")}, "removed_absent": {"edges": row("edges", 9, 1, 1, "removed")},
        "not_unique": {"nodes": row("nodes", 7, "a", "added")}, "repeated": {"nodes": row("nodes", 1, "q", "modified").unionByName(row("nodes", 1, "r", "modified"))},
    }
    empty = {n: df.limit(0).withColumn("op", F.lit("added")) for n, df in new.items()}
    for problem, change in bad.items():
        with pytest.raises(deltas.Invalid, match=problem):
            deltas.commit(store, held, empty | {n: df.select(*[F.col(c).cast(new[n].schema[c].dataType) if c != "op" else F.col(c) for c in df.columns]) for n, df in change.items()}, SCHEMA, 1)
    assert store.generation() == 1 and all(rows(deltas.tables(store, {n: df.schema for n, df in new.items()})[n]) == rows(new[n]) for n in SCHEMA)
    with pytest.raises(Conflict):
        deltas.commit(store, held, empty, SCHEMA, 0)


def test_merge_by_fields(spark):
    make = lambda *r: spark.createDataFrame(list(r), "id string, visibility string, signature string, body string")
    base = make(("compose", "P", "s", "b"), ("clash", "P", "s", "b"), ("alike", "P", "s", "b"), ("gone", "P", "s", "b"), ("kept", "P", "s", "b"), ("both gone", "P", "s", "b"), ("some", "P", "s", "b"))
    ours = make(("compose", "Q", "s", "b"), ("clash", "P", "x", "b"), ("alike", "P", "x", "b"), ("kept", "P", "s", "b2"), ("new", "P", "1", "b"), ("mine", "P", "s", None), ("some", "P", "x", "b1"))
    theirs = make(("compose", "P", "s2", "b"), ("clash", "P", "y", "b"), ("alike", "P", "x", "b"), ("gone", "P", "s", "b"), ("new", "P", "2", "b"), ("some", "P", "y", "b"))
    got = {r.id: r for r in deltas.merge_fields(base, ours, theirs, "id", ["visibility", "signature", "body"]).collect()}
    assert {i: r.kind for i, r in got.items()} == {"compose": "composed", "clash": "divergent", "alike": "convergent", "kept": "modify_delete", "new": "add_add", "mine": "ours", "some": "divergent"}
    assert (got["compose"].visibility, got["compose"].signature, got["compose"].visibility_change, got["compose"].signature_change) == ("Q", "s2", "Q>P", True)
    assert (got["clash"].signature, got["clash"].conflicts) == ("s", "signature") and (got["some"].body, got["some"].conflicts) == ("b1", "signature") and got["alike"].signature == "x"


def test_window_before_a_base(spark):
    line = [(i, i - 1 if i else None, None) for i in range(60)] + [(100, 59, 58), (101, 100, 777), (200, 7, None)]
    changes = spark.createDataFrame(line, "id long, parent long, merged long")
    bases = spark.createDataFrame([("line", 50), ("merge", 101), ("lost", 778), ("short", 200)], "review string, base long")
    got = {}
    for r in reverts.base_windows(bases, changes, 12).orderBy("place").collect():
        got.setdefault(r.review, []).append((r.change, r.distance, r.known))
    assert got["line"] == [(50 - i, i, True) for i in range(12)]
    assert got["merge"][:6] == [(101, 0, True), (100, 1, True), (777, 1, False), (59, 2, True), (58, 2, True), (57, 3, True)] and sum(k for *_, k in got["merge"]) == 12
    assert got["lost"] == [(778, 0, False)] and len(got["short"]) == 9
    gaps = {(r.review, r.gap): (r.n, r["first"], r.distance) for r in reverts.evidence_gaps(reverts.base_windows(bases, changes, 12), 12, 10).collect()}
    assert gaps == {("merge", "incomplete_ancestry"): (1, 777, 1), ("lost", "incomplete_ancestry"): (1, 778, 0), ("lost", "shallow"): (0, None, None), ("short", "shallow"): (9, None, None)}


def test_revert_findings(spark):
    changes = spark.createDataFrame([(i, i - 1 if i else None, None) for i in range(6)], "id long, parent long, merged long")
    edits = [
        (1, "f", "modified", 1, 2), (1, "g", "modified", 1, 2), (2, "t", "modified", 1, 2), (0, "old", "added", None, 9), (3, "old", "removed", 9, None), (0, "twin", "added", None, 8), (4, "twin", "removed", 8, None), (4, "young", "added", None, 5),
        (10, "f", "modified", 2, 3), (11, "f", "modified", 3, 1), (10, "g", "modified", 2, 1), (10, "t", "modified", 2, 1), (10, "again", "added", None, 9), (10, "name", "added", None, 7), (11, "young", "removed", 5, None), (11, "other", "added", None, 4),
    ]
    log = spark.createDataFrame(edits, "change long, entity string, op string, old long, new long")
    who = [("f", "Function", "f", "Public", "Source"), ("g", "Class", "g", "Public", "Source"), ("t", "Function", "t", "Public", "Test"), ("old", "Function", "o", "Public", "Source"), ("again", "Function", "n", "Public", "Source"), ("twin", "Class", "w", "Public", "Source"), ("name", "Class", "w", "Public", "Source"), ("young", "Class", "y", "Public", "Source"), ("other", "Class", "z", "Public", "Source")]
    entities = spark.createDataFrame(who, "id string, kind string, name string, visibility string, role string")
    windows = reverts.base_windows(spark.createDataFrame([("r", 5)], "review string, base long"), changes)
    ranges = spark.createDataFrame([("r", 10, 1), ("r", 11, 2)], "review string, change long, n int")
    got = {(r.entity, r.shape): (r.distance, r.undone, r.gates) for r in reverts.revert_findings(windows, log, ranges, entities).collect()}
    assert got == {("f", "restored_body"): (4, 1, True), ("g", "restored_body"): (4, 1, False), ("t", "restored_body"): (3, 2, False), ("again", "reintroduced"): (2, None, True), ("name", "same_name"): (1, None, False), ("young", "recent_removal"): (1, None, False)}


def test_context_pack_fits_its_budget(spark):
    entities = spark.createDataFrame([("a", "Function", "a", "a ( x )", "one two three"), ("b", "Function", "b", "b ( )", "body"), ("c", "Class", "c", "c", None)], "id string, kind string, name string, signature string, body string")
    relations = spark.createDataFrame([("1", "Calls", "a", "b"), ("2", "Calls", "b", "c")], "id string, kind string, src string, dst string")
    extras = spark.createDataFrame([("test", "t1", "b", "checks b"), ("test", "t1", "a", "checks b"), ("work", "w", "c", "far"), ("note", "n", "a", "long " * 100)], "section string, id string, about string, text string")
    focal = spark.createDataFrame([("a",), ("zz",)], "id string")
    got = [(r.section, r.id, r.tokens, r.total) for r in context.context_pack(focal, entities, relations, extras, 60).orderBy("total").collect()]
    assert got == [("focal", "a", 3, 3), ("dependency_signature", "b", 3, 6), ("transitive", "c", 2, 8), ("test", "t1", 2, 10)]
    assert [r.id for r in context.context_pack(focal, entities, relations, extras, 7).orderBy("total").collect()] == ["a", "b"]
    assert {r.id for r in context.context_pack(focal, entities, relations, extras).collect()} == {"a", "b", "c", "t1", "n"}
    paths = {(r.root, r.goal, r.hops, r.path) for r in context.focal_routes(spark.createDataFrame([("a",), ("b",), ("c",)], "id string"), relations).collect()}
    assert paths == {("a", "b", 1, "a>b"), ("a", "c", 2, "a>b>c"), ("b", "c", 1, "b>c")}


def test_typed_traversal_goes_through_what_is_not_recorded(spark):
    edges = spark.createDataFrame([("1", "Calls", "entity", "a", "external", "x"), ("2", "Calls", "entity", "b", "external", "x"), ("3", "Tests", "test", "a", "entity", "a")], "id string, kind string, src_kind string, src string, dst_kind string, dst string")
    nodes = spark.createDataFrame([("entity", "a"), ("entity", "b")], "kind string, id string")
    start = spark.createDataFrame([("entity", "a")], "kind string, id string")
    found, touched = g.traverse(start, edges, nodes, 2)
    assert {(r.kind, r.id, r.hop, r.known) for r in found.collect()} == {("entity", "a", 0, True), ("external", "x", 1, False), ("test", "a", 1, False), ("entity", "b", 2, True)}
    assert {r.relation for r in touched.collect()} == {"1", "2", "3"}
    assert {r.id for r in g.traverse(start, edges, nodes, 2, ["Tests"])[0].collect()} == {"a"}


def test_entry_points(spark):
    e = spark.createDataFrame([(1, "main", "src/nk/cli.py"), (2, "Db.run", "src/nk/cli.py"), (3, "run", "nk/cli/__init__.py"), (4, "main", "bin/x.rs"), (5, "helper", "bin/x.rs"), (6, "main", None), (7, "run", "other/xcli.py")], "id long, name string, file string")
    d = spark.createDataFrame([("main", "nk.cli", None), ("Db.run", ".nk.cli.", None), (None, None, "./bin/x.rs"), ("x", None, None), (None, " ", "")], "symbol string, module string, file string")
    assert {r.id for r in fl.entry_points(e, d).collect()} == {1, 2, 3, 4}


def test_entry_points_take_whole_ends_of_paths(spark):
    e = spark.createDataFrame([(1, "main", "a/b.tar.rs"), (2, "run", "nk/cli/__init__.py"), (3, "run", "nk/xcli.py"), (4, "run", "nk/cli.py")], "id long, name string, file string")
    d = spark.createDataFrame([(None, None, "b.tar.rs"), ("x.run", None, "cli/__init__.py"), ("m.run", "cli", None)], "symbol string, module string, file string")
    assert {r.id for r in fl.entry_points(e, d).collect()} == {1, 2, 4}
    plan = fl.entry_points(e, d)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "endswith" not in plan  # rows meet by equal values, not by trying all of a file's name


def test_satisfaction_spreads_equal_needs_last(spark):
    need = spark.createDataFrame([(i, m, 0) for i in (1, 2, 3) for m in "mn"] + [(4, "m", 0)], "interface int, member string, arity int")
    offer = spark.createDataFrame([("A", "m", 0), ("A", "n", 0), ("B", "m", 0)], "class string, member string, arity int")
    got = fl.satisfied(need, offer)
    assert {tuple(r) for r in got.collect()} == {(1, "A", 2), (2, "A", 2), (3, "A", 2), (4, "A", 1), (4, "B", 1)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("Project") and plan.split("\n")[1].lstrip("+- ").startswith("Join")


def test_satisfaction_shuffles_what_is_offered_once(spark):
    need = spark.createDataFrame([(i, m, i % 2) for i in range(6) for m in "mn"], "interface int, member string, arity int")
    offer = spark.createDataFrame([(c, m, c % 3) for c in range(9) for m in ("mn" if c % 2 else "m")] + [(1, "m", 1)], "class int, member string, arity int")
    got = fl.satisfied(need, offer)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1 and "ENSURE_REQUIREMENTS" not in plan
    assert {tuple(r) for r in got.collect()} == {(i, c, 2) for i in range(6) for c in range(1, 9, 2) if i % 2 == c % 3}


def test_unresolved_imports_and_arity(spark):
    e = spark.createDataFrame([("a", "Source", "f"), ("v", "External", "third_party/f"), ("x", "External", None)], "id string, role string, file string")
    r = [("1", "Calls", "a", "x", "crate", "p::q.get"), ("2", "Calls", "a", "v", "crate", "g"), ("3", "Calls", "a", "nobody", "crate", "g"), ("4", "Calls", "a", "x", "", "g"), ("5", "Calls", "a", "x", None, "g"), ("6", "Calls", "a", "x", "c", "<a/b>"), ("7", "Imports", "a", "x", "c", "g"), ("8", "References", "z", "x", "c", "g"), ("9", "References", "a", "x", "c", None)]
    rel = spark.createDataFrame(r, "id string, kind string, src string, dst string, import_source string, token string")
    assert {(x.id, x.imported) for x in fl.unresolved_imports(e, rel).collect()} == {("1", "get"), ("3", "g")}
    need = spark.createDataFrame([("I", "m", 1), ("I", "n", 0), ("J", "m", 2)], "interface string, member string, arity int")
    offer = spark.createDataFrame([("A", "m", 1), ("A", "n", 0), ("B", "m", 1), ("C", "m", 2), ("C", "n", 0)], "class string, member string, arity int")
    assert {(x["interface"], x["class"]) for x in fl.satisfied(need, offer).collect()} == {("I", "A"), ("J", "C")}


def test_signals_and_locate(spark):
    hits = spark.createDataFrame([("q", 1, 4.0, 0.25, None, 3.0, None), ("q", 2, 2.0, 1.5, 8.0, None, -1.0), ("z", 3, None, None, 0.0, 0.5, 0.5)], "query string, id long, bm25 double, distance double, graph double, proof double, provenance double")
    got = {r.id: tuple(r)[2:] for r in rt.signals_of(hits).collect()}
    assert got == {1: (1.0, 0.75, 0.0, 1.0, 0.0), 2: (0.5, 0.0, 1.0, 0.0, 0.0), 3: (0.0, 0.0, 0.0, 0.5, 0.5)}
    scores = spark.createDataFrame([("q", 1, "search", 9.0), ("q", 2, "search", 5.0), ("q", 2, "projection", 1.0), ("q", 3, "unknown", 1.0)], "query string, id long, signal string, score double")
    found = {r.id: r for r in rt.locate(scores).collect()}
    assert found.keys() == {1, 2} and found[2]["rank"] == 1 and found[2].signals == 2 and found[1].search_score == 2 / 61 and found[2].projection_present == 1 and found[1].projection_score == 0.0


def test_scan_finds_what_all_postings_tell(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "red bolt red", "web"), (2, "blue bolt", None), (3, None, "web red"), (4, "...", ""), (5, "nut " * 40, "x")], "doc_id long, text string, source string")
    asked = spark.createDataFrame([(0, "red"), (0, "web"), (0, "absent"), (7, "bolt"), (7, "red")], "query int, token string")
    fields, stored, cut = {"text": 1.0, "source": 3.0}, [], rt.cut
    monkeypatch.setattr(rt, "cut", lambda df, path=None: stored.append(cut(df, path)) or stored[-1])
    near = lambda df: {(x["query"], x.doc_id, round(x.score, 9)) for x in df.collect()}
    want = near(rt.bm25(rt.postings(docs, "doc_id", fields), asked, "doc_id"))
    assert near(rt.scan(docs, asked, "doc_id", fields)) == want and len(want) == 5
    assert {x.token for x in stored[0].collect()} == {"", "red", "web", "bolt"}


def test_coverage_trust_and_semantic_diff(spark):
    ids, runs = spark.createDataFrame([(1,), (2,), (3,)], "id long"), spark.createDataFrame([(1, "passing"), (1, "failing"), (2, "failing"), (9, "passing")], "id long, status string")
    assert tuple(rv.proof_coverage(ids, runs).first()) == (3, 1, 0.333333, 3, 2, True)
    assert tuple(rv.proof_coverage(ids, runs.where("false")).first()) == (3, 0, 0.0, 0, 0, False)
    assert tuple(rv.proof_coverage(ids.where("false"), runs).first())[:3] == (0, 0, 0.0)
    make = lambda *r: spark.createDataFrame(list(r), "id string, file string, sig string, line int")
    found, hidden = h.semantic_diff(make(("a", "f", "s", 1), ("b", "f", "s", 1), ("c", "g", "s", 1)), make(("a", "f", "s", 2), ("b", "f", "t", 2), ("d", "g", "s", 1)), "id", ["sig"], ["line"])
    assert rows(found) == [("b", "f", "modified"), ("c", "g", "removed"), ("d", "g", "added")] and hidden.first()[0] == 1


def test_verification_plan(spark):
    make = lambda cols, *r: spark.createDataFrame(list(r), cols)
    plan = rv.verification_plan(make("id string", ("s",)), make("root string, node string", ("s", "i"), ("s", "idle")), make("entity string, test string", ("s", "t1"), ("i", "t2")), make("entity string, work string", ("i", "w1"), ("idle", "w2")), make("work string, test string", ("w1", "t3"), ("w2", "t9x")), make("test string, at int, status string", ("t1", 1, "failing"), ("t1", 2, "passing")))
    assert {tuple(r) for r in plan.collect()} == {("s", "test", "t1", "passing"), ("s", "test", "t2", None), ("s", "test", "t3", None), ("s", "test", "t9x", None), ("s", "entity", "s", None), ("s", "entity", "i", None), ("s", "entity", "idle", None), ("s", "work", "w1", None), ("s", "work", "w2", None)}


def test_saved_index_is_checked(spark):
    from loomgraph.sources import compact

    e = spark.createDataFrame([("a", "Class", "A", "f"), ("b", "Class", "B", None)], "id string, kind string, name string, file string")
    r = spark.createDataFrame([("a", "b"), ("a", "b"), ("x", "b"), ("b", "a")], "src string, dst string")
    path, built = f"{checkpoint_dir(spark)}/compact-{uuid.uuid4().hex}", compact.build(e, r)
    compact.save(built, path)
    got = compact.load(spark, path, built.schema)
    assert {(x.id, x.incoming, x.outgoing) for x in got.collect()} == {("a", 1, 1), ("b", 2, 1)}
    folder = Store(spark, path).marks()[1]
    got.where("id = 'a'").write.mode("append").parquet(f"{path}/data/{folder}/rows")
    with pytest.raises(compact.Damaged):
        compact.load(spark, path, built.schema)


def test_dependencies_beyond_manifests(spark):
    from loomgraph.operators.artifacts import detected

    flow = "jobs:\n  - uses: actions/checkout@v4\n    with:\n      repository: acme/tools\n  - uses: actions/checkout@v4\n  - run: x\n    repository: acme/not-this\n  - uses: other/step\n    repository: acme/nor-this\n"
    files = [
        ("r", "Dockerfile", "FROM acme/base:1 AS b\nFROM other/x\n  FROM ghcr.io/acme/app\nRUN FROM acme/no"), ("r", "deploy/docker-compose.dev.yml", "image: 'acme/db:2'\nimage: x/y\nbuild: ./svc/api/\nbuild: ./svc/unknown"), ("r", ".github/workflows/ci.yml", flow),
        ("r", "src/lib.rs", "use core_model::X;\nuse other::Y;\n// use core_model::Z;"), ("r", "a.ts", "import {a} from '@acme/ui'\nconst x = 'from core_model'"), ("r", "run.py", "subprocess.run(['api', 'x'])"), ("r", "no.py", "x = ['api']"), ("r", "net.go", "get(\"localhost:8001\")\n# 127.0.0.1:8002\nget('127.0.0.1:8009')\n"),
    ]
    df = spark.createDataFrame(files, "repo string, path string, text string")
    got = {(x.name, x.provider, x.source) for x in detected(df, ["api", "web"], "acme", {"core_model": "core", "@acme/ui": "ui"}, {8001: "web", 8002: "api", 8009: "gone"}).collect()}
    assert got == {("docker:base", "base", "dockerfile"), ("docker:app", "app", "dockerfile"), ("compose:db", "db", "compose"), ("compose-build:api", "api", "compose"), ("ci:tools", "tools", "ci"), ("import:core_model", "core", "protocol"), ("import:@acme/ui", "ui", "protocol"), ("bin:api", "api", "subprocess"), ("http:localhost:8001", "web", "http")}


def test_text_of_a_file_is_made_once(spark):
    from pyspark.sql import functions as F

    from loomgraph.operators.artifacts import detected

    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(path):
        made.add(1)
        return {"Dockerfile": "FROM acme/a", "run.py": "subprocess.run(['api'])"}.get(path, "get('localhost:8001')")

    paths = ["Dockerfile", "docker-compose.yml", ".github/workflows/ci.yml", "main.rs", "run.py", "net.ts"]
    df = spark.createDataFrame([("r", p) for p in paths], "repo string, path string").withColumn("text", text("path"))
    got = {x.name for x in detected(df, ["api"], "acme", {"core": "core-repo"}, {8001: "api"}).collect()}
    assert got == {"docker:a", "bin:api", "http:localhost:8001"} and made.value == len(paths)


def test_lines_of_files_with_odd_blanks(spark):
    from loomgraph.operators.artifacts import detected

    files = [
        ("r", "Dockerfile.ts", "\tFROM\t acme/a:1\r\nFROM acme/a:2\nFROM  \nacme/no\r\nuse core::X;\r\n \x0buse\tcore::Y;\nimport x from 'u\ti'\nimport x\x85from 'core'\n"),
        ("r", "docker-compose.yml", "\timage:\t\"acme/d:1\" \r\nbuild: ./x/api//\t\nimage: acme/\u2028e\nimage: acme/f\u2028\nbuild:\nweb"),
        ("r", "n.txt", " \t// localhost:8001\n\r# 127.0.0.1:8001\n* localhost:8001\nx // localhost:8002 127.0.0.1:8003\nlocalhost:\n8001"), ("r", None, "localhost:8004"), ("r", "run.py", None), (None, "b.py", "execa 'api' 'web\nAPI_GATE_BINARY"),
    ]
    df = spark.createDataFrame(files, "repo string, path string, text string")
    got = sorted(tuple(x) for x in detected(df.coalesce(1), ["api", "web", "api-gate"], "acme", {"core": "c", "u i": "ui"}, {8001: "api", 8002: "web", 8003: "gone", 8004: "api"}).fillna("-").collect())
    assert got == [
        ("-", "bin:api", "api", "subprocess"), ("-", "bin:api-gate", "api-gate", "subprocess"), ("r", "compose-build:api", "api", "compose"), ("r", "compose:d", "d", "compose"), ("r", "compose:f", "f", "compose"), ("r", "docker:a", "a", "dockerfile"),
        ("r", "http:localhost:8002", "web", "http"), ("r", "http:localhost:8004", "api", "http"), ("r", "import:core", "c", "protocol"), ("r", "import:u i", "ui", "protocol"),
    ]


def test_ten_signals_are_dealt_out_once_by_query(spark, sf_dir):
    from loomgraph.plans import QUERIES

    plan = QUERIES["j11_ten_signals"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    # lines, orders, and all signals by query; on small tables each is one partition
    exchanges = [line for line in plan.splitlines() if "Exchange " in line and "BroadcastExchange" not in line]
    assert len(exchanges) == 3 and all("REPARTITION_BY_NUM" in line for line in exchanges)

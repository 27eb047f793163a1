"""The persisted text index: commits, reopening, pruning, frequencies."""

import re
import uuid

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import retrieval as rt
from loomgraph.sources.store import Conflict, checkpoint_dir
from loomgraph.sources.text_index import TextIndex, current, fingerprint

FIELDS = {"name": 5.0, "body": 1.5}


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, name string, body string")


def asked(spark, **queries):
    return spark.createDataFrame([(q, t) for q, words in queries.items() for t in words.split()], "query string, token string")


def scores(df):
    return {(r.query, r.id): round(r.score, 9) for r in df.collect()}


def test_commits_equal_a_rebuild_in_a_new_session(spark):
    path = f"{checkpoint_dir(spark)}/text-{uuid.uuid4().hex}"
    index = TextIndex(spark, path, buckets=8)
    with pytest.raises(Conflict):
        index.commit(frame(spark, [(1, "a", "b")]), frame(spark, []), FIELDS)
    index.rebuild(frame(spark, [(i, f"parseNode{i % 3}", f"walk tree {i}") for i in range(30)] + [(99, None, "gone soon")]), FIELDS, "one")
    index.commit(frame(spark, [(3, "renamed", "leaf"), (50, "parse", "new tree"), (99, "back", "tree")]), frame(spark, [(4, None, None), (99, None, None), (777, None, None)]), FIELDS, "two")
    index.commit(frame(spark, []), frame(spark, [(50, None, None)]), FIELDS, "three")
    index.commit(frame(spark, [(50, "again", "tree tree")]), frame(spark, []), FIELDS, "four")
    final = [(i, f"parseNode{i % 3}", f"walk tree {i}") for i in range(30) if i not in (3, 4)] + [(3, "renamed", "leaf"), (99, "back", "tree"), (50, "again", "tree tree")]
    other = spark.newSession()
    opened = TextIndex(other, path, read_only=True)
    assert opened.documents == len(final) and opened.root == "four" and opened.generation == 4
    queries = asked(other, a="parse node1 tree", b="gone leaf", c="nothing here", d="back 7")
    want = scores(rt.bm25(rt.postings(frame(other, final), "id", FIELDS), queries, "id"))
    assert scores(opened.search(queries)) == pytest.approx(want) and want
    assert {r.id for r in opened.contains(frame(other, [(3, "", ""), (4, "", ""), (50, "", "")])).collect()} == {3, 50}
    with pytest.raises(PermissionError):
        opened.commit(frame(other, []), frame(other, []), FIELDS)
    index.compact()
    assert list(index.parts) == [5] and index.root == "four" and scores(index.search(queries)) == pytest.approx(want)
    with pytest.raises(Conflict):  # it still is at generation 4
        TextIndex._write(opened_for_writing(opened), "part", rt.postings(frame(spark, final), "id", FIELDS), frame(spark, []).select("id"), 0, 0.0, "x")


def opened_for_writing(index):
    index.read_only = False
    return index


def test_a_search_reads_the_partitions_of_its_tokens(spark):
    path = f"{checkpoint_dir(spark)}/text-{uuid.uuid4().hex}"
    index = TextIndex(spark, path, buckets=16)
    index.rebuild(frame(spark, [(i, f"n{i}", "tree") for i in range(40)]), FIELDS)
    plan = index.postings(asked(spark, a="tree"))._jdf.queryExecution().executedPlan().toString()
    bucket = spark.range(1).select(index.bucket(F.lit("tree"))).first()[0]
    assert f"PartitionFilters: [isnotnull(bucket#" in plan and f"= {bucket})]" in plan


def test_frequencies_and_empty_index(spark):
    path = f"{checkpoint_dir(spark)}/text-{uuid.uuid4().hex}"
    docs = frame(spark, [(1, "Alpha beta", ""), (2, "alpha", "beta beta"), (3, "alpha", None)])
    index = current(spark, path, "id", docs, FIELDS)
    terms = spark.createDataFrame([("x", "alpha"), ("x", "beta"), ("y", "alpha"), ("z", "alpha"), ("z", "none")], "term string, token string")
    assert {tuple(r) for r in index.frequencies(terms).collect()} == {("x", 2), ("y", 3), ("z", 0)}
    assert current(spark, path, "id", docs, FIELDS).generation == 1
    assert current(spark, path, "id", frame(spark, []), FIELDS).documents == 0
    assert TextIndex(spark, path).search(asked(spark, a="alpha")).count() == 0
    assert fingerprint(docs) == fingerprint(docs.orderBy(F.desc("id"))) != fingerprint(docs.where("id < 3"))


def test_scoring_shuffles_postings_alone(spark, monkeypatch):
    docs = frame(spark, [(i, f"parseNode{i % 3}", f"walk tree {i}") for i in range(20)])
    queries = asked(spark, a="parse node1 tree", b="walk 7")
    found = rt.bm25(rt.postings(docs, "id", FIELDS), queries, "id")
    assert not re.search(r"hashpartitioning\(query#\d+, id#", found._jdf.queryExecution().executedPlan().toString())
    want = scores(found)
    monkeypatch.setattr(rt, "ASKED", 0)
    assert scores(rt.bm25(rt.postings(docs, "id", FIELDS), queries, "id")) == pytest.approx(want) and want


def test_scoring_bounds_what_a_task_meets(spark, monkeypatch):
    docs = frame(spark, [(i, f"parseNode{i % 3}", f"walk tree {i}") for i in range(20)])
    queries = asked(spark, a="parse tree", b="parse")  # 20 documents have each, so 60 meetings
    want = scores(rt.bm25(rt.postings(docs, "id", FIELDS), queries, "id"))
    monkeypatch.setattr(rt, "MET", 7)
    found = rt.bm25(rt.postings(docs, "id", FIELDS), queries, "id")
    assert re.search(r"hashpartitioning\(id#\w+, 9\), REPARTITION_BY_NUM", found._jdf.queryExecution().executedPlan().toString())
    assert scores(found) == pytest.approx(want) and want

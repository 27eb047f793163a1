"""Derived tables kept in step with a feed, through duplicates, gaps and lag."""

import uuid

import pytest
from pyspark.sql import functions as F

from loomgraph.sources.store import checkpoint_dir
from loomgraph.streaming import incremental


def test_runs():
    assert incremental.runs([(5, 5), (1, 2), (3, 3), (5, 7), (9, 9)]) == [(1, 3), (5, 7), (9, 9)]


class Held:
    def __init__(self):
        self.exists, self.get = False, None

    def update(self, value):
        self.exists, self.get = True, value


def test_follow():
    import pandas as pd

    def batch(state, *rows):
        parts = [pd.DataFrame(list(rows[:2]), columns=["source", "seq", "file", "type"]), pd.DataFrame(list(rows[2:]), columns=["source", "seq", "file", "type"])]
        got = pd.concat(list(incremental.follow(("s",), iter(parts), state)))
        return set(got.file.dropna()), bool(got.resync.any())

    s, row = Held(), lambda seq, file="f", kind="modified": ("s", seq, file, kind)
    assert batch(s, row(2, "b"), row(1, "a"), row(3, "c"), row(2, "b")) == ({"a", "b", "c"}, False)
    assert batch(s, row(3, "c"), row(4, "d")) == ({"d"}, False) and s.get == (4,)  # a frame again
    assert batch(s, row(6, "e")) == ({"e"}, True) and s.get == (6,)  # 5 is missing
    assert batch(s, row(7, "f"), row(9, "g")) == ({"f", "g"}, True)
    assert batch(s, row(10, "h"), row(None, None, "lagged")) == ({"h"}, True) and s.get == (-1,)
    assert batch(s, row(40, "i"), row(41, "j")) == ({"i", "j"}, False) and s.get == (41,)


@pytest.mark.parametrize("lost", ["gap", "lagged"])
def test_three_batches_with_a_loss_equal_a_rebuild(spark, lost):
    base = f"{checkpoint_dir(spark)}/inc-{uuid.uuid4().hex}"
    trees = [{("a", "1"): 1, ("a", "2"): 1, ("b", "1"): 1}, {("a", "1"): 2, ("a", "2"): 1, ("b", "1"): 1, ("b", "9"): 7}, {("a", "1"): 2, ("a", "3"): 5, ("b", "9"): 7}, {("a", "1"): 2, ("a", "3"): 6, ("b", "9"): 8}]
    frames = [[("a", 1, "1", "modified"), ("b", 1, "9", "added")], [("a", 2, "2", "removed"), ("a", 3, "3", "added"), ("b", 2, "1", "removed")], [("a", 4, "3", "modified"), ("b", 3, "9", "modified")]]
    frames[1] = frames[1][1:] if lost == "gap" else [("a", None, None, "lagged"), frames[1][2]]
    now, derived = [0], []
    tree = lambda: spark.createDataFrame([(*k, v) for k, v in trees[now[0]].items()], "source string, file string, entry long")

    def derive(files):
        derived.append({(r.source, r.file) for r in files.collect()})
        return files.select("source", "file", F.explode(F.sequence(F.lit(1), F.col("entry"))).alias("id"))

    out = incremental.Derived(spark, f"{base}/table", tree, derive)
    out.start()
    for i, rows in enumerate(frames):
        now[0] = i + 1
        spark.createDataFrame(rows, incremental.FRAMES).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(incremental.FRAMES).parquet(f"{base}/in")
        incremental.keep_up(stream, out, f"{base}/state")
    assert {(r.source, r.file, r.id) for r in out.rows().collect()} == {(*k, i) for k, v in trees[-1].items() for i in range(1, v + 1)}
    assert {(r.source, r.file): r.entry for r in out.files().collect()} == trees[-1]
    assert derived[1] == {("a", "1"), ("b", "9")} and derived[2] == {("a", "3")}  # the second also finds by comparing what it lost
    out.apply(spark.createDataFrame([("a", "3", False), ("b", "9", False)], incremental.FOUND), 2)  # a batch again
    assert {(r.source, r.file): r.entry for r in out.files().collect()} == trees[-1]

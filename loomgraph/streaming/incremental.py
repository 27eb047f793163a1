"""Keeps what is derived from files in step with a feed of file changes, and starts a source anew when its feed has a gap.

Frames have source, seq (one more with each frame of a source), file and type; a frame of type `lagged` has no seq and
says that frames were lost. State is kept by source: the last seq of an unbroken run. Only the files of new frames are
derived again, from the tree as it is now; of a source with a gap those that differ from what is held.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .feed import run

FRAMES = "source string, seq long, file string, type string"
FOUND = "source string, file string, resync boolean"


def runs(seqs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Closed intervals of integers, joined where they touch."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(seqs):
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def follow(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """The files of a source's new frames, and a row with resync if frames are missing.

    Frames may come twice and in any order within a batch; what is kept of them while it runs is their runs of seq. State:
    the last seq, or -1 if the next frame may have any, as after `lagged`.
    """
    last = state.get[0] if state.exists else 0
    seen: list[tuple[int, int]] = []
    lagged = False
    for part in frames:
        lagged |= bool((part.type == "lagged").any())
        part = part[part.seq.notna() & (part.seq > last)]
        seq = sorted({int(s) for s in part.seq})
        seen = runs(seen + [(s, s) for s in seq])
        files = part.file.dropna().unique()
        yield pd.DataFrame({"source": key[0], "file": files, "resync": False})
    start = seen[0][0] if seen and last == -1 else last + 1
    if lagged or len(seen) > 1 or seen and seen[0][0] != start:
        yield pd.DataFrame({"source": [key[0]], "file": [None], "resync": [True]})
    state.update((-1 if lagged else seen[-1][1] if seen else last,))


def followed(frames: DataFrame) -> DataFrame:
    return frames.groupBy("source").applyInPandasWithState(follow, FOUND, "seq long", "append", "NoTimeout")


def tree_diff(held: DataFrame, now: DataFrame) -> DataFrame:
    """(source, file, change) of trees (source, file, entry): added, modified or removed."""
    both = held.withColumnRenamed("entry", "before").join(now.withColumnRenamed("entry", "after"), ["source", "file"], "full_outer")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "modified")
    return both.select("source", "file", change.alias("change")).where("change is not null")


class Derived:
    """Files and what is derived from them, below a path; each batch is a folder of its own, so that replays change nothing.

    tree() gives the files as they are now (source, file, entry: not null); derive(files) what follows from some of them,
    with source and file.
    """

    def __init__(self, spark: SparkSession, path: str, tree: Callable[[], DataFrame], derive: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.tree, self.derive = spark, path, tree, derive

    def _write(self, files: DataFrame, number: int) -> None:
        """files (source, file): those that may have changed."""
        now = files.join(self.tree(), ["source", "file"], "left")
        now.write.mode("overwrite").parquet(f"{self.path}/files/batch={number}")
        held = self.spark.read.schema(now.schema).parquet(f"{self.path}/files/batch={number}")
        self.derive(held.where("entry is not null")).write.mode("overwrite").parquet(f"{self.path}/rows/batch={number}")

    def start(self) -> None:
        """Derives everything."""
        self._write(self.tree().select("source", "file"), 0)

    def apply(self, found: DataFrame, number: int) -> None:
        """found: what followed() gives for a batch."""
        found = found.persist()
        anew = found.where("resync").select("source").distinct()
        files = found.where("not resync").select("source", "file").join(anew, "source", "left_anti").distinct()
        lost = tree_diff(self.files(number + 1).join(anew, "source", "left_semi"), self.tree().join(anew, "source", "left_semi"))
        self._write(files.unionByName(lost.select("source", "file")), number + 1)
        found.unpersist()

    def _last(self, before: int | None = None) -> DataFrame:
        files = self.spark.read.option("basePath", f"{self.path}/files").parquet(f"{self.path}/files/batch=*")
        files = files.where(F.col("batch") < before) if before is not None else files
        return files.groupBy("source", "file").agg(F.max_by("entry", "batch").alias("entry"), F.max("batch").alias("batch"))

    def files(self, before: int | None = None) -> DataFrame:
        """(source, file, entry) as held after the batches before one."""
        return self._last(before).where("entry is not null").select("source", "file", "entry")

    def rows(self) -> DataFrame:
        """What is derived from the files held: of each file, the rows of its last batch."""
        rows = self.spark.read.option("basePath", f"{self.path}/rows").parquet(f"{self.path}/rows/batch=*")
        return rows.join(self._last().where("entry is not null").select("source", "file", "batch"), ["source", "file", "batch"], "left_semi").drop("batch")


def keep_up(frames: DataFrame, derived: Derived, checkpoint: str) -> None:
    """Runs all that a stream of frames has, a batch at a time."""
    run(followed(frames), derived.apply, checkpoint)

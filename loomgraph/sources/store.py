"""Tables in files: reading by name, cutting lineage, and a snapshot-and-delta store with compare-and-swap."""

from __future__ import annotations

import re
import tempfile
import time
import uuid
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: About how many rows of what is read a task gets where it holds its rows in memory.
TASK_ROWS = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a temporary one, in one process only (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, path: str | None = None) -> DataFrame:
    """df, computed once into the shared folder and read again: a cut of its lineage whose columns can be pruned."""
    path = path or new_folder(df.sparkSession, "cut")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rows_read(df: DataFrame) -> int:
    """Rows in the Parquet files below df, from their footers."""
    files = [unquote(f) for f in df.inputFiles()]
    return df.sparkSession.read.schema("unread int").parquet(*files).count() if files else 0


def dealt(df: DataFrame, *columns: str, rows: int | None = None, each: int | None = None) -> DataFrame:
    """df dealt out by columns to so many tasks that each gets about `each` rows of what is read, or of `rows`; AQE merges none of them.

    An aggregate or a sort by these columns then holds as much in a task whatever the input.
    """
    return df.repartition(parts(rows_read(df) if rows is None else rows, each), *columns)


def parts(rows: int, each: int | None = None) -> int:
    return max(1, -(-rows // (each or TASK_ROWS)))


def bucketed(df: DataFrame, column: str, rows: int, each: int | None = None) -> DataFrame:
    """df, dealt out by a column and computed once into as many buckets in the shared folder: what meets it by that column is shuffled alone."""
    spark, name = df.sparkSession, f"loomgraph_{uuid.uuid4().hex}"
    dealt(df, column, rows=rows, each=each).write.format("parquet").option("compression", "zstd").option("path", new_folder(spark, "buckets")).bucketBy(parts(rows, each), column).saveAsTable(name)
    got = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name alone: files of a given path stay
    return got


class Conflict(RuntimeError):
    """Another writer has moved the generation on."""


class Store:
    """Snapshots and deltas of one repository's table below a folder.

    A generation is a number. A writer puts its files into a folder of its own, then creates the generation's marker
    without overwriting and writes the folder's name into it. So of two writers at one generation one fails with
    Conflict, and its files are never read; a writer that fails before the marker leaves nothing that counts. A marker
    that was created and never filled counts neither; `stale_s` seconds later the next writer creates another one of the
    same generation beside it. The first that is filled counts, so a writer fills its own within half of that time or
    fails. Markers are never deleted to be taken over. Reads use Spark only; the markers are small files that the driver
    handles through Hadoop's file system, which must be able to create a file only if there is none (HDFS and local
    folders are; object stores need a committer or conditional writes for that).
    """

    def __init__(self, spark: SparkSession, path: str, stale_s: float = 600):
        self.spark, self.path, self.stale_s = spark, path.rstrip("/"), stale_s
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def marks(self) -> dict[int, str]:
        """Folder (snapshot-... or delta-...) by generation."""
        folder = self._path(f"{self.path}/marks")
        if not self._fs.exists(folder):
            return {}
        found = {}
        for s in self._fs.listStatus(folder):
            if s.getLen() > 0:
                generation, _, attempt = s.getPath().getName().partition(".")
                found[int(generation), int(attempt or 0)] = s.getPath()
        first = {}
        for (generation, _), path in sorted(found.items(), key=lambda f: f[0], reverse=True):
            first[generation] = path
        out = {}
        for generation, path in first.items():
            stream = self._fs.open(path)
            out[generation] = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
        return out

    def generation(self) -> int:
        return max(self.marks(), default=0)

    def _of(self, kind: str) -> dict[int, str]:
        return {g: name for g, name in self.marks().items() if name.startswith(kind)}

    def _claim(self, generation: int, name: str) -> None:
        attempt = 0
        while True:
            marker = self._path(f"{self.path}/marks/{generation}" + (f".{attempt}" if attempt else ""))
            try:
                stream, began = self._fs.create(marker, False), time.time()
                break
            except Exception as e:
                status = self._fs.getFileStatus(marker) if self._fs.exists(marker) else None
                if status is None or status.getLen() > 0 or time.time() - status.getModificationTime() / 1000 < self.stale_s:
                    raise Conflict(f"generation {generation} was taken") from e
                attempt += 1
        if generation in self.marks() or self.stale_s and time.time() - began > self.stale_s / 2:
            stream.close()
            raise Conflict(f"generation {generation} was taken")
        stream.write(bytearray(name.encode()))
        stream.close()

    def _save(self, df: DataFrame, expected: int, kind: str) -> int:
        if self.generation() != expected:
            raise Conflict(f"generation is {self.generation()}, not {expected}")
        name = f"{kind}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/data/{name}")
        return self.publish(name, expected)

    def publish(self, name: str, expected: int) -> int:
        """Makes a folder below data/, already written, the generation after the expected one."""
        self._claim(expected + 1, name)
        return expected + 1

    def save_snapshot(self, df: DataFrame, expected: int) -> int:
        return self._save(df, expected, "snapshot")

    def save_delta(self, df: DataFrame, expected: int) -> int:
        """df has an `op` column (added, modified, removed) beside the table's own."""
        return self._save(df, expected, "delta")

    def _read(self, folders: dict[int, str]) -> DataFrame | None:
        """The rows of some folders, with their generation."""
        parts = [self.spark.read.parquet(f"{self.path}/data/{name}").withColumn("generation", F.lit(g)) for g, name in sorted(folders.items())]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def snapshot(self) -> tuple[DataFrame | None, int]:
        found = self._of("snapshot")
        g = max(found, default=0)
        return self._read({g: found[g]} if g else {}), g

    def deltas(self, since: int) -> DataFrame | None:
        """Delta rows of later generations, with their generation."""
        return self._read({g: name for g, name in self._of("delta").items() if g > since})

    def recover(self, key: str) -> DataFrame | None:
        """The newest snapshot with the later deltas applied."""
        from ..operators.history import apply_deltas

        base, g = self.snapshot()
        later = self.deltas(g)
        if base is None or later is None:
            return base.drop("generation") if base is not None else None
        return apply_deltas(base.drop("generation"), later.withColumnRenamed("generation", "ord"), key)

    def clear_deltas(self) -> None:
        """Deletes deltas that the newest snapshot holds; refuses while later ones count."""
        _, g = self.snapshot()
        old = self._of("delta")
        if any(n > g for n in old):
            raise Conflict("deltas are newer than the snapshot")
        for n, name in old.items():
            for s in self._fs.globStatus(self._path(f"{self.path}/marks/{n}{{,.*}}")):
                self._fs.delete(s.getPath(), False)
            self._fs.delete(self._path(f"{self.path}/data/{name}"), True)


def overlay(base: DataFrame, session: DataFrame, key: str) -> DataFrame:
    """The base as a session sees it: its rows replace those of the same key; rows whose `gone` is true leave."""
    kept = base.join(session.select(key).distinct(), key, "left_anti")
    return kept.unionByName(session.where(~F.coalesce("gone", F.lit(False))).drop("gone"))

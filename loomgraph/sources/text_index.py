"""A persisted text index: postings in tables that outlive the session, with commits of changes and removals.

A commit is a folder with `postings` (token, key, tf; partitioned by a hash of the token and sorted by it), `lengths`
(key, length), `gone` (keys whose earlier rows no longer count) and `stats` (live documents, their total length, the root
of the data that the index stands for). The store's markers make commits atomic: of two at one generation one fails, and
a commit that breaks off is never read. A search reads only the partitions and, by Parquet's statistics, the row groups
that hold its tokens.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval as rt
from .store import Conflict, Store

#: Files into which the postings of a hash bucket are dealt out, so that a very frequent token isn't one task's.
SPREAD = 4
STATS = "docs long, total double, root string, buckets int, kind string"


class TextIndex:
    """The index below a path, at the generation it was opened at; read_only refuses commits."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id", buckets: int = 64, read_only: bool = False):
        self.spark, self.path, self.key, self.buckets, self.read_only = spark, path.rstrip("/"), key, buckets, read_only
        self.store = Store(spark, path)
        self.refresh()

    def refresh(self) -> None:
        """Looks at the commits that there are now."""
        marks = self.store.marks()
        full = max((g for g, name in marks.items() if name.startswith("full-")), default=0)
        self.parts = {g: name for g, name in sorted(marks.items()) if g >= full}
        self.generation = max(self.parts, default=0)
        self.stats = self.spark.read.schema(STATS).parquet(f"{self.path}/data/{self.parts[self.generation]}/stats").first() if self.parts else None
        if self.stats:
            self.buckets, self.kind = self.stats.buckets, self.stats.kind

    def _table(self, name: str, what: str) -> DataFrame:
        schema = {"postings": f"{self.key} {self.kind}, token string, tf double, bucket int", "lengths": f"{self.key} {self.kind}, length double", "gone": f"{self.key} {self.kind}"}[what]
        return self.spark.read.schema(schema).parquet(f"{self.path}/data/{name}/{what}")

    @property
    def documents(self) -> int:
        return self.stats.docs if self.stats else 0

    @property
    def root(self) -> str | None:
        return self.stats.root if self.stats else None

    def bucket(self, token: Column) -> Column:
        return F.pmod(F.xxhash64(token), F.lit(self.buckets)).cast("int")

    def _live(self, what: str, keep: Column | None = None) -> DataFrame:
        """Rows of all commits but those of keys that a later commit replaced or removed."""
        rows, later = None, None
        for g, name in self.parts.items():
            part = self._table(name, what).withColumn("generation", F.lit(g))
            rows = part if rows is None else rows.unionByName(part)
            if g > min(self.parts):
                gone = self._table(name, "gone").withColumn("replaced", F.lit(g))
                later = gone if later is None else later.unionByName(gone)
        rows = rows.where(keep) if keep is not None else rows
        if later is not None:
            later = later.groupBy(self.key).agg(F.max("replaced").alias("replaced"))
            rows = rows.join(later, self.key, "left").where(F.col("replaced").isNull() | (F.col("replaced") <= F.col("generation"))).drop("replaced")
        return rows.drop("generation")

    def _write(self, kind: str, posts: DataFrame, gone: DataFrame | None, docs: int, total: float, root: str) -> None:
        if self.read_only:
            raise PermissionError("the index was opened for reading only")
        name = f"{kind}-{uuid.uuid4().hex}"
        folder = f"{self.path}/data/{name}"
        dealt = posts.withColumn("bucket", self.bucket(F.col("token")))
        dealt = dealt.repartition("bucket", F.pmod(F.xxhash64(self.key), F.lit(SPREAD))).sortWithinPartitions("bucket", "token")
        dealt.write.partitionBy("bucket").parquet(f"{folder}/postings")
        self.kind = posts.schema[self.key].dataType.simpleString()
        self._table(name, "postings").groupBy(self.key).agg(F.sum("tf").alias("length")).write.parquet(f"{folder}/lengths")
        if gone is not None:
            gone.write.parquet(f"{folder}/gone")
        new = self._table(name, "lengths").agg(F.count("*").alias("docs"), F.sum("length").alias("total")).first()
        stats = [(docs + new.docs, total + (new.total or 0.0), root, self.buckets, self.kind)]
        self.spark.createDataFrame(stats, STATS).coalesce(1).write.parquet(f"{folder}/stats")
        self.store.publish(name, self.generation)
        self.refresh()

    def rebuild(self, docs: DataFrame, fields: dict[str, float], root: str = "") -> None:
        """Starts anew from documents (key, fields)."""
        self._write("full", rt.postings(docs, self.key, fields), None, 0, 0.0, root)

    def commit(self, docs: DataFrame, removed: DataFrame, fields: dict[str, float], root: str = "") -> None:
        """Adds or replaces documents and removes keys, at once; a key that is in both is replaced."""
        if not self.parts:
            raise Conflict("there is no index yet")
        gone = docs.select(self.key).unionByName(removed.select(self.key)).distinct()
        old = self._live("lengths").join(gone, self.key, "left_semi").agg(F.count("*").alias("docs"), F.sum("length").alias("total")).first()
        self._write("part", rt.postings(docs, self.key, fields), gone, self.stats.docs - old.docs, self.stats.total - (old.total or 0.0), root)

    def compact(self) -> None:
        """One commit in place of all; the root stays."""
        self._write("full", self._live("postings").select(self.key, "token", "tf"), None, 0, 0.0, self.root)

    def postings(self, tokens: DataFrame) -> DataFrame:
        """Live postings of tokens (token). The buckets to read are known before the read, at most as many as there are."""
        wanted = [r.b for r in tokens.select(self.bucket(F.col("token")).alias("b")).distinct().collect()]
        return self._live("postings", F.col("bucket").isin(wanted)).join(tokens.select("token").distinct(), "token", "left_semi").drop("bucket")

    def search(self, queries: DataFrame, limit: int | None = None) -> DataFrame:
        """(query, key, score) of queries (query, token) by BM25."""
        total = self.spark.range(1).select(F.lit(self.documents).alias("docs"), F.lit(self.stats.total / max(self.documents, 1)).alias("mean"))
        return rt.bm25(self.postings(queries), queries, self.key, limit, self._live("lengths"), total)

    def frequencies(self, terms: DataFrame) -> DataFrame:
        """(term, df) of terms (term, token): how many documents have a term's rarest token."""
        df = self.postings(terms).groupBy("token").agg(F.count("*").alias("df"))
        return terms.distinct().join(df, "token", "left").groupBy("term").agg(F.min(F.coalesce("df", F.lit(0))).alias("df"))

    def contains(self, keys: DataFrame) -> DataFrame:
        """Keys that a search can find now."""
        return keys.join(self._live("lengths").select(self.key), self.key, "left_semi")


def fingerprint(docs: DataFrame) -> str:
    """A root for the rows of a table, whatever their order."""
    r = docs.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*docs.columns).cast("decimal(38,0)")).alias("s")).first()
    return f"{r.n}:{r.s or 0}"


def current(spark: SparkSession, path: str, key: str, docs: DataFrame, fields: dict[str, float]) -> TextIndex:
    """The index below a path, rebuilt if it isn't that of these documents."""
    index, root = TextIndex(spark, path, key), fingerprint(docs)
    if index.root != root:
        index.rebuild(docs, fields, root)
    return index

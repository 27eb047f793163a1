"""The change feed on Structured Streaming: filters, idempotent upserts, pass counters, expiry.

A feed row has seq (ever growing), id, type, value and at. Sources are files; a test reads a folder of Parquet files as
a stream and runs to its end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import checkpoint_dir

FEED = "seq long, id string, type string, value double, at timestamp_ntz"


def read_feed(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(FEED).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def only(feed: DataFrame, types: list[str]) -> DataFrame:
    """Some types; gaps in seq then are no loss."""
    return feed.where(F.col("type").isin(*types))


def latest(rows: DataFrame) -> DataFrame:
    """The last row of each id by seq."""
    return rows.groupBy("id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "id"]), "seq").alias("r")).select("id", "r.*")


def run(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Runs all that a stream has, a batch at a time."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


class Replica:
    """A table kept in step with a feed: snapshot up to a seq, then upserts; each batch is a new folder, so replays are idempotent."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def start(self, snapshot: DataFrame) -> None:
        snapshot.write.mode("overwrite").parquet(f"{self.path}/batch=-1")

    def upsert(self, batch: DataFrame, number: int) -> None:
        latest(batch).write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def state(self) -> DataFrame:
        """Live rows: the last of each id by seq, without those whose last row removes them. Rows up to the snapshot's seq change nothing."""
        rows = self.spark.read.option("basePath", self.path).parquet(f"{self.path}/batch=*").drop("batch")
        return latest(rows).where("type <> 'removed'")


def pass_counts(batch: DataFrame) -> DataFrame:
    """The five counters that close a pass."""
    is_ = lambda t: F.count(F.when(F.col("type") == t, 1))
    return batch.agg(is_("added").alias("added"), is_("modified").alias("modified"), is_("removed").alias("removed"), F.count("*").alias("events"), F.max("seq").alias("last_seq"))


def sessions(feed: DataFrame, gap: str, late: str) -> DataFrame:
    """Extension: sessions of an id that end after a gap, behind a watermark; seqs and values of each."""
    timed = feed.withColumn("time", F.col("at").cast("timestamp")).withWatermark("time", late)
    return timed.groupBy("id", F.session_window("time", gap)).agg(F.count("*").alias("events"), F.max("seq").alias("last_seq"), F.round(F.sum("value"), 6).alias("value"))


def replayed(spark: SparkSession, rows: DataFrame, batches: int, make: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """Writes rows as a feed of several files in order of seq, streams them through make() and returns what came out."""
    import uuid

    base = f"{checkpoint_dir(spark)}/feed-{uuid.uuid4().hex}"
    rows.repartitionByRange(batches, "seq").sortWithinPartitions("seq").write.parquet(f"{base}/in")
    out = make(read_feed(spark, f"{base}/in"))
    query = out.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


def replicated(spark: SparkSession, snapshot: DataFrame, rows: DataFrame, batches: int) -> DataFrame:
    """The state of a replica after a snapshot and a feed that overlaps it."""
    import uuid

    base = f"{checkpoint_dir(spark)}/feed-{uuid.uuid4().hex}"
    rows.repartitionByRange(batches, "seq").write.parquet(f"{base}/in")
    replica = Replica(spark, f"{base}/table")
    replica.start(snapshot)
    run(read_feed(spark, f"{base}/in"), replica.upsert, f"{base}/state")
    return replica.state()

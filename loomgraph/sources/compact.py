"""A read-only index of entities with their numbers of relations, saved with a checksum that opening compares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stats import digest, partners
from .store import Store

COLUMNS = ("id", "kind", "name", "file", "incoming", "outgoing")


class Damaged(ValueError):
    """What is stored is not what was saved."""


def build(entities: DataFrame, relations: DataFrame) -> DataFrame:
    rows = entities.join(partners(relations, "dst", "src", "incoming"), "id", "left").join(partners(relations, "src", "dst", "outgoing"), "id", "left")
    return rows.fillna(0, ["incoming", "outgoing"]).select(*COLUMNS)


def checksum(rows: DataFrame) -> str:
    """SHA-256 of the rows' digest, whatever their order."""
    return digest(rows).select(F.sha2(F.concat_ws("|", "rows", "xor", "total"), 256).alias("s")).first().s


def save(rows: DataFrame, path: str) -> None:
    """Sorted by id, so that a lookup reads few row groups; published with its checksum as one generation."""
    spark = rows.sparkSession
    store, name = Store(spark, path), f"index-{uuid.uuid4().hex}"
    rows.repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{store.path}/data/{name}/rows")
    saved = spark.read.schema(rows.schema).parquet(f"{store.path}/data/{name}/rows")
    spark.createDataFrame([(checksum(saved),)], "checksum string").coalesce(1).write.parquet(f"{store.path}/data/{name}/checksum")
    store.publish(name, store.generation())


def load(spark: SparkSession, path: str, schema) -> DataFrame:
    """The newest index below a path, or Damaged."""
    store = Store(spark, path)
    folder = f"{store.path}/data/{store.marks()[store.generation()]}"
    rows = spark.read.schema(schema).parquet(f"{folder}/rows")
    if checksum(rows) != spark.read.schema("checksum string").parquet(f"{folder}/checksum").first().checksum:
        raise Damaged(path)
    return rows

"""A keyed store of values that is added to and replaced in: the cache of embeddings by content.

    PATH/batch=B   key, seq, and the values

A batch is one write of rows; the later batch replaces what earlier ones hold of a key, and in a
batch the row with the largest `seq` counts. Writing a batch again replaces it as a whole. Old
batches are never touched: a write that is cut short leaves readers what they had. compact() writes
what counts to another folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def key_of(model: str, text: Column) -> Column:
    """Key of a text under a model."""
    return F.sha2(F.concat(F.lit(model), F.lit("\0"), text), 256)


def _latest(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row a key, the last by `order`; combined before the shuffle, so that a key of many rows is no burden."""
    values = [c for c in rows.columns if c not in ("key", *order)]
    last = rows.groupBy("key").agg(F.max(F.struct(*order, *values)).alias("_last"))
    return last.select("key", *[F.col(f"_last.{c}").alias(c) for c in rows.columns if c != "key"])


def put(rows: DataFrame, path: str, batch: int) -> None:
    """Write rows (key, seq, values) as a batch; keys replace those of earlier batches. Null keys are left out.

    Equal keys with an equal seq: the larger values count.
    """
    last = _latest(rows.where(F.col("key").isNotNull()), ["seq"])
    out = last.withColumn("batch", F.lit(batch).cast("int"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def latest(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """(key, values) as they stand, or stood after the batch `upto`."""
    rows = spark.read.parquet(path)
    if upto is not None:
        rows = rows.where(F.col("batch") <= upto)
    return _latest(rows, ["batch", "seq"]).drop("batch", "seq")


def missing(keys: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """Rows of `keys` (key, ...) whose key no batch holds; keys that are few go to the store's."""
    held = spark.read.parquet(path).select("key")
    few = keys.limit(1_000_001).count() <= 1_000_000
    own = held.join(F.broadcast(keys.select("key").distinct()), "key", "left_semi").distinct() if few else held
    return keys.join(own, "key", "left_anti")


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Write what counts to another folder, as one batch."""
    rows = _latest(spark.read.parquet(path), ["batch", "seq"])
    rows.withColumn("batch", F.lit(0)).write.mode("overwrite").partitionBy("batch").parquet(target)

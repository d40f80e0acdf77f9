"""Sharding by weighted rendezvous hashing of record keys, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of a shard that are numbered independently; 8 shards hold 8 * 1024 of them.
BUCKETS = 1024


def _score(key: Column, shard: int, weight: float) -> Column:
    """-weight / ln(u) with u uniform in (0, 1) from the pair of key and shard; 52 bits, so that no u rounds to 1."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 12) + F.lit(0.5)) * F.lit(2.0**-52)
    return F.struct((F.lit(-float(weight)) / F.log(u)).alias("score"), F.lit(-shard).alias("rank"))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the highest score for this key.

    A shard gets keys in proportion to its weight. Adding a shard changes no other score, so keys
    move only into the new one. A null key has a fixed shard of its own.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    scores = [_score(key, i, w) for i, w in enumerate(weights)]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return (-best["rank"]).cast("int")


def assign(docs: DataFrame, weights: Sequence[float] = (1.0,) * 8, buckets: int = BUCKETS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard, slot and grown shard of every row.

    Returns doc_id, size, text_crc32, law ('key'), shard, slot, grown_shard. Null text counts as
    empty: size 1, crc32 0. Slots run from 0 without gaps in each shard: a hashed bucket of the
    key is numbered by itself and shifted by the rows of the buckets before it, so no task holds
    a shard. The shift table has len(weights) * buckets rows at most, which bounds its broadcast.
    Repeated rows get slots of their own, those of one key in one task; an empty table gives no rows.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    shard = rendezvous(F.col(key), weights)
    bucket = F.pmod(F.xxhash64(F.col(key), F.lit("slot")), F.lit(buckets)).cast("int")
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(value).cast("long") + 1).alias("size"),
        F.crc32(value).alias("text_crc32"),
        shard.alias("shard"),
        rendezvous(F.col(key), [*weights, 1.0]).alias("grown_shard"),
        bucket.alias("_bucket"),
    )
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        docs.select(shard.alias("shard"), bucket.alias("_bucket"))
        .groupBy("shard", "_bucket")
        .agg(F.count("*").alias("_n"))
        .select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy("shard", "_bucket").orderBy("doc_id", "size", "text_crc32")
    numbered = rows.withColumn("_at", F.row_number().over(inside) - 1).join(F.broadcast(shift), ["shard", "_bucket"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_at") + F.col("_before")).alias("slot"), "grown_shard")

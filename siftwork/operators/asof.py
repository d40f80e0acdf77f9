"""Joins by nearness in an order: the last row at or before another, and rows within a window of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwork.operators import scan


def last_before(left: DataFrame, right: DataFrame, by: list[str], at: str, values: list[str], least: int = scan.LEAST) -> DataFrame:
    """`left` with the `values` of the row of `right` with the same `by` and the greatest `at` not above its own; null if none.

    The two sides are put in one order, in which the last right row is carried on: each side is
    sorted once and no pair is made. A group with more than its share of the rows is cut into pieces.
    Right rows with an equal `at`: the largest values. Rows without `at`, or null in `by`: no match.
    """
    shared = [*by, at]
    known = right.dropna(subset=shared).select(*shared, F.struct(*values).alias("_v"))
    both = left.withColumn("_side", F.lit(1)).unionByName(known.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    cut, large = scan.pieces(both, by, F.col(at).cast("double"), least)
    order = Window.partitionBy(*by, "_piece").orderBy(at, "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    out = cut.withColumn("_last", F.last("_v", ignorenulls=True).over(order))
    if large:
        ends = cut.groupBy(*by, "_piece").agg(F.max(F.when(F.col("_v").isNotNull(), F.struct(at, "_v"))).alias("_end"))
        before = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
        earlier = ends.withColumn("_earlier", F.last("_end._v", ignorenulls=True).over(before)).where("_piece > 0").drop("_end")
        joined = out.alias("l").join(F.broadcast(earlier).alias("r"), scan.same("l", "r", [*by, "_piece"]), "left")
        out = joined.select("l.*", "r._earlier").withColumn("_last", F.coalesce("_last", "_earlier")).drop("_earlier")
    usable = F.col(at).isNotNull()
    return out.where("_side = 1").select(*left.columns, *[F.when(usable, F.col(f"_last.{v}")).alias(v) for v in values])


def within(left: DataFrame, right: DataFrame, by: list[str], at: Column, place: Column, width: int) -> DataFrame:
    """Pairs of rows with the same `by` where 0 <= _far <= width, _far being left's `at` less right's `place` (integers).

    Both sides meet in buckets of `width`: a left row looks into its own bucket and the one before it,
    so that a group of any length is joined piece by piece. The columns of the sides must differ, but for `by`.
    """
    bucket = lambda c: F.floor(c / width)
    near = left.withColumn("_at", at).withColumn("_bucket", F.explode(F.array(bucket(F.col("_at")), bucket(F.col("_at")) - 1)))
    pairs = near.join(right.withColumn("_place", place).withColumn("_bucket", bucket(F.col("_place"))), [*by, "_bucket"])
    return pairs.withColumn("_far", F.col("_at") - F.col("_place")).where(F.col("_far").between(0, width)).drop("_bucket", "_at", "_place")

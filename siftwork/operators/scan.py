"""Running sums, maxima and row numbers of groups of any size, by parts of a group and their totals.

A window over a whole group is one task's work. Here a group with more than its share of the rows
is cut into pieces at approximate quantiles of the order; windows run within pieces, and what the
pieces before it hold is added to each. Only the quantiles of such groups, fewer than SHARE of
them, come to the driver. Tables without such groups get the plain window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A group is cut that has more than one in SHARE of the rows, and more than LEAST; into so many pieces.
SHARE, LEAST, PIECES = 1000, 200_000, 64

_OF = {"sum": F.sum, "max": F.max}
_WITH = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + b, "max": lambda a, b: F.greatest(a, b)}


def same(left: str, right: str, names: list[str]) -> Column:
    """Equality of columns of two aliased sides, nulls together."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}")) for n in names], F.lit(True))


def pieces(df: DataFrame, by: list[str], at: Column, least: int = LEAST) -> tuple[DataFrame, bool]:
    """(`df` with _piece, rising with `at` within its group; whether any group was cut).

    Rows with equal `at` share a piece, so that it should have few ties; null belongs to the first piece.
    """
    counts = df.groupBy(*by).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    large = counts.where(F.col("_n") > max(least, total // SHARE))
    if not by:  # the table is one group
        large = large if total > least else large.limit(0)
    if large.isEmpty():
        return df.withColumn("_piece", F.lit(0)), False
    cuts = [k / PIECES for k in range(1, PIECES)]
    own = df.withColumn("_at", at.cast("double"))
    rows = own.alias("l").join(F.broadcast(large.select(*by, F.lit(True).alias("_large"))).alias("r"), same("l", "r", by)).select("l.*")
    found = rows.groupBy(*by).agg(F.percentile_approx("_at", cuts, 100 * PIECES).alias("_cuts"))
    schema = T.StructType([*[df.schema[n] for n in by], T.StructField("_cuts", T.ArrayType(T.DoubleType()))])
    fixed = df.sparkSession.createDataFrame(found.collect(), schema)  # the same cuts for every reading
    joined = own.alias("l").join(F.broadcast(fixed).alias("r"), same("l", "r", by), "left").select("l.*", "r._cuts")
    piece = F.size(F.filter(F.array_distinct("_cuts"), lambda c: c < F.col("_at")))
    return joined.withColumn("_piece", F.when(F.col("_cuts").isNull(), 0).otherwise(piece)).drop("_at", "_cuts"), True


def running(df: DataFrame, by: list[str], order: list[Column | str], at: Column, made: dict[str, tuple[str, Column]], own: bool = True, least: int = LEAST) -> DataFrame:
    """`df` with columns over the rows of its group up to each row, or before it (own=False).

    made: name -> ('sum' or 'max', of what). `at` is a number that rises in the given order. Before
    the first row a sum and a maximum are null.
    """
    cut, large = pieces(df, by, at, least)
    inside = Window.partitionBy(*by, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    out = cut.withColumns({name: _OF[kind](of).over(inside) for name, (kind, of) in made.items()})
    if not large:
        return out.drop("_piece")
    totals = cut.groupBy(*by, "_piece").agg(*[_OF[kind](of).alias(f"_{name}") for name, (kind, of) in made.items()])
    before = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    earlier = totals.select(*by, "_piece", *[_OF[kind](f"_{name}").over(before).alias(f"_{name}") for name, (kind, _) in made.items()])
    earlier = earlier.where("_piece > 0")  # of cut groups, PIECES rows each at most
    both = out.alias("l").join(F.broadcast(earlier).alias("r"), same("l", "r", [*by, "_piece"]), "left")
    add = {name: F.coalesce(_WITH[kind](F.col(f"r._{name}"), F.col(f"l.{name}")), F.col(f"l.{name}"), F.col(f"r._{name}")).alias(name) for name, (kind, _) in made.items()}
    return both.select(*[add.get(c, F.col(f"l.{c}")) for c in out.columns if c != "_piece"])


def numbered(df: DataFrame, by: list[str], order: list[Column | str], at: Column, name: str, least: int = LEAST) -> DataFrame:
    """`df` with the row number from 1 within its group."""
    return running(df, by, order, at, {name: ("sum", F.lit(1))}, least=least)


def at_rank(counts: DataFrame, by: list[str], value: str, rank, least: int = LEAST) -> DataFrame:
    """(by, value): of each group the value at the rank that `rank` makes of its number of rows; counts (by, value, c)."""
    upto = running(counts, by, [value], F.col(value), {"_upto": ("sum", F.col("c"))}, least=least)
    every = counts.groupBy(*by).agg(F.sum("c").alias("_all"))
    both = upto.alias("l").join(every.alias("r"), same("l", "r", by)).select("l.*", "r._all")
    return both.where(F.col("_upto") >= rank(F.col("_all"))).groupBy(*by).agg(F.min(value).alias(value))

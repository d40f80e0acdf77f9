"""Connected components of a graph in DataFrames, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component): the smallest id reachable, for the ids of `edges` (a, b).

    Each round maps every node to the smallest of itself and its neighbours, follows that map to
    its end and contracts the edges; the number of nodes with edges at least halves. Tables are written between rounds, so
    that plans stay short and lost executors cost little. Loops and repeated edges are harmless.
    """
    links = scratch.keep(edges.select("a", "b").where("a != b").distinct())
    known = scratch.keep(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().select("id", F.col("id").alias("component")))
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        lower = scratch.keep(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")))
        # Follow the map to its end, twice as far each time: every node then names a local minimum.
        step = lower
        while True:
            jump = step.select(F.col("a").alias("_to"), F.col("low").alias("_lower"))
            further = F.coalesce("_lower", "low")
            step = scratch.keep(step.join(jump, step["low"] == jump["_to"], "left").select("a", further.alias("low"), (further != F.col("low")).alias("moved")))
            if step.where("moved").isEmpty():
                break
            step = step.drop("moved")
        known = scratch.keep(known.join(step, known["component"] == step["a"], "left").select("id", F.coalesce("low", "component").alias("component")))
        left = step.select(F.col("a").alias("_a"), F.col("low").alias("_la"))
        right = step.select(F.col("a").alias("_b"), F.col("low").alias("_lb"))
        moved = links.join(left, links["a"] == left["_a"]).join(right, links["b"] == right["_b"])
        links = scratch.keep(moved.select(F.col("_la").alias("a"), F.col("_lb").alias("b")).where("a != b").distinct())
    return known

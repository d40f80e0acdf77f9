"""Ranking metrics, sweeps and calibration over long tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwork.operators import scan


def ranking(hits: DataFrame, grades: DataFrame, k: int = 10) -> DataFrame:
    """For each qid of `grades`: precision, recall, hit, rr, dcg, ndcg and ap at k.

    hits: (qid, id, rank); grades: (qid, id, grade), relevant from grade 2 on. Precision divides by
    k; recall without relevant rows is 0; the ideal ranking takes all grades; ap divides by
    min(relevant, k).
    """
    gain = lambda g: F.pow(F.lit(2.0), g) - 1
    ideal_order = Window.partitionBy("qid").orderBy(F.desc("grade"), "id")
    ideal = grades.withColumn("_i", F.row_number().over(ideal_order)).groupBy("qid").agg(
        F.sum(F.when(F.col("_i") <= k, gain(F.col("grade")) / F.log2(F.col("_i") + 1))).alias("idcg"),
        F.count(F.when(F.col("grade") >= 2, 1)).alias("n"),
    )
    seen = hits.where(F.col("rank") <= k).join(grades, ["qid", "id"])
    rel = (F.col("grade") >= 2).cast("int")
    running = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    seen = seen.withColumn("_rel", rel).withColumn("_so_far", F.sum("_rel").over(running))
    found = seen.groupBy("qid").agg(
        F.sum("_rel").alias("r"),
        F.min(F.when(F.col("_rel") == 1, F.col("rank"))).alias("first"),
        F.sum(gain(F.col("grade")) / F.log2(F.col("rank") + 1)).alias("dcg"),
        F.sum(F.when(F.col("_rel") == 1, F.col("_so_far") / F.col("rank"))).alias("ap"),
    )
    r = F.coalesce("r", F.lit(0))
    return ideal.join(found, "qid", "left").select(
        "qid",
        F.round(r / k, 6).alias("precision"),
        F.round(F.coalesce(r / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0)), 6).alias("recall"),
        (r > 0).cast("long").alias("hit"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("rr"),
        F.round(F.coalesce("dcg", F.lit(0.0)), 6).alias("dcg"),
        F.round(F.coalesce(F.col("dcg") / F.nullif(F.col("idcg"), F.lit(0.0)), F.lit(0.0)), 6).alias("ndcg"),
        F.round(F.coalesce(F.col("ap") / F.nullif(F.least(F.col("n"), F.lit(k)), F.lit(0)), F.lit(0.0)), 6).alias("ap"),
    )


METRICS = ("precision", "recall", "hit", "rr", "dcg", "ndcg", "ap")


def macro(per_query: DataFrame, groups: list[str]) -> DataFrame:
    """Means of all metrics over everything and over each value of `groups`, in one pass."""
    out = per_query.groupingSets([[], *[[g] for g in groups]], *groups) if groups else per_query.groupBy()
    return out.agg(F.count("*").alias("n"), *[F.round(F.avg(m), 4).alias(m) for m in METRICS])


def precision_ceiling(grades: DataFrame, k: int) -> DataFrame:
    n = grades.groupBy("qid").agg(F.count(F.when(F.col("grade") >= 2, 1)).alias("n"))
    return n.agg(F.round(F.avg(F.least("n", F.lit(k)) / k), 6).alias("ceiling"))


def nearest_rank_p95(values: DataFrame, value: str, by: str) -> DataFrame:
    """sorted[int(.95 n) - 1], and for one value that value."""
    counts = values.groupBy(by, value).agg(F.count("*").alias("c"))
    return scan.at_rank(counts, [by], value, lambda n: F.greatest(F.lit(1), F.floor(n * 0.95))).select(by, F.col(value).alias("p95"))


def latencies(rows: DataFrame, by: list[str], group: str, value: str = "ms") -> DataFrame:
    """(by, group or 'all', n, p50, p95): the median and sorted[int(.95 n) - 1] of each group and of all of `by`.

    Values are counted first, and ranks found by running sums over distinct values.
    """
    both = rows.withColumn(group, F.explode(F.array(F.col(group).cast("string"), F.lit("all"))))
    keys = [*by, group]
    counts = both.groupBy(*keys, value).agg(F.count("*").alias("c"))
    at = lambda rank, name: scan.at_rank(counts, keys, value, rank).withColumnRenamed(value, name)
    low, high = at(lambda n: F.floor((n + 1) / 2), "_a"), at(lambda n: F.floor(n / 2) + 1, "_b")
    out = counts.groupBy(*keys).agg(F.sum("c").alias("n")).join(low, keys).join(high, keys)
    out = out.join(at(lambda n: F.greatest(F.lit(1), F.floor(n * 0.95)), "p95"), keys)
    return out.select(*keys, "n", F.round((F.col("_a") + F.col("_b")) / 2, 6).alias("p50"), "p95")


def refusal_sweep(scores: DataFrame, steps: int = 89) -> DataFrame:
    """Thresholds .01, .02, ... over (answerable, confidence); refusing is below the threshold.

    Scores are first counted per hundredth, so that a threshold meets 101 counts and not all rows.
    """
    slot = F.greatest(F.lit(0), F.least(F.lit(100), F.floor(F.col("confidence") * 100 + 1e-9))).cast("int")
    counts = scores.groupBy(slot.alias("slot")).agg(F.count(F.when(F.col("answerable"), 1)).alias("yes"), F.count(F.when(~F.col("answerable"), 1)).alias("no"))
    at = scores.sparkSession.range(1, steps + 1).select(F.col("id").cast("int").alias("step"))
    joined = counts.crossJoin(F.broadcast(at))  # 101 counts by `steps` thresholds
    up = F.col("slot") >= F.col("step")
    sums = joined.groupBy("step").agg(F.sum(F.when(up, F.col("yes")).otherwise(0)).alias("tp"), F.sum(F.when(~up, F.col("yes")).otherwise(0)).alias("fn"), F.sum(F.when(up, F.col("no")).otherwise(0)).alias("fp"), F.sum(F.when(~up, F.col("no")).otherwise(0)).alias("tn"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    p, r, t = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn")), ratio(F.col("tn"), F.col("tn") + F.col("fp"))
    return sums.select("step", "tp", "fn", "fp", "tn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(ratio(2 * p * r, p + r), 6).alias("f1"), F.round((r + t) / 2, 6).alias("balanced"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    return sweep.orderBy(F.desc("balanced"), F.desc("f1"), "step").limit(1)

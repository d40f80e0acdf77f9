"""Views of the standard tables in the record shapes of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwork.session import pin, table


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(pin(spark), d, "documents")


def texts(spark, d) -> DataFrame:
    return documents(spark, d).select(F.col("doc_id").alias("id"), "text")


def vectors(spark, d) -> DataFrame:
    return table(pin(spark), d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def asked(spark, d) -> DataFrame:
    """The stated query set: every row whose id is divisible by 100."""
    return vectors(spark, d).where("id % 100 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))


def questions(spark, d) -> DataFrame:
    return table(pin(spark), d, "benchmark").select(F.col("item_id").alias("qid"), "text")


def spans(spark, d) -> DataFrame:
    """The whole text of each question in spans of 60 characters, the last with the rest: the first of grade 3, the others of grade 2."""
    q = table(pin(spark), d, "benchmark")
    last = F.greatest(F.floor(F.length("text") / 60).cast("int") - 1, F.lit(0))
    cut = q.select(F.col("item_id").alias("qid"), "text", last.alias("_last"), F.explode(F.sequence(F.lit(0), last)).alias("_i"))
    span = F.col("text").substr(F.col("_i") * 60 + 1, F.when(F.col("_i") == F.col("_last"), F.length("text")).otherwise(60))
    return cut.select("qid", span.alias("span"), F.when(F.col("_i") == 0, 3).otherwise(2).alias("grade"))


def graded_chunks(spark, d) -> DataFrame:
    """Documents as chunks: of the document that their source is, a hundred ids being a section."""
    section = F.floor(F.col("doc_id") / 100).cast("string")
    return documents(spark, d).select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"), section.alias("section"), "text")


def pages(spark, d) -> DataFrame:
    """Documents of a source as the pages of one."""
    order = Window.partitionBy("source").orderBy("doc_id")
    docs = documents(spark, d)
    numbers = docs.select("doc_id", F.row_number().over(order).alias("page_no"))  # ids alone meet by source, texts by id
    return docs.join(numbers, "doc_id").select(F.col("source").alias("doc_id"), "page_no", "text")


def truth_boxes(spark, d) -> DataFrame:
    li = table(pin(spark), d, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    x, y, q = (F.col("l_partkey") % 200).cast("double"), (F.col("l_suppkey") % 100).cast("double"), F.col("l_quantity").cast("double")
    return li.select(
        F.col("l_orderkey").cast("long").alias("image_id"), F.row_number().over(order).cast("long").alias("pos"), F.col("l_returnflag").alias("cls"),
        x.alias("x1"), y.alias("y1"), (x + 20 + q).alias("x2"), (y + 20 + q).alias("y2"), (F.col("l_discount") < 0.01).alias("ign"), F.col("l_tax").cast("double").alias("l_tax"), "l_suppkey", "l_partkey",
    )


def found_boxes(spark, d) -> DataFrame:
    g = truth_boxes(spark, d).where("l_tax < 0.075D")
    shift = F.col("l_tax") * 100
    conf = F.lit(0.3) + ((F.col("l_partkey") * 7 + F.col("pos") * 13) % 100) / F.lit(200.0)
    return g.select("image_id", "pos", F.when(F.col("l_suppkey") % 11 == 0, "A").otherwise(F.col("cls")).alias("cls"), (F.col("x1") + shift).alias("x1"), "y1", (F.col("x2") + shift).alias("x2"), "y2", conf.alias("conf"))


def user_frames(spark, d) -> DataFrame:
    """Events as track rows: user = track, hour = frame, the last event of an hour counts."""
    e = table(pin(spark), d, "events")
    frame = F.floor(F.unix_timestamp("ts") / 3600).cast("long")
    order = Window.partitionBy("user_id", "_f").orderBy(F.desc("event_id"))
    rows = e.withColumn("_f", frame).withColumn("_r", F.row_number().over(order)).where("_r = 1")
    return rows.select(F.col("user_id").cast("long").alias("track_id"), F.col("_f").alias("frame"), F.col("event_type").alias("cls"), F.col("value").cast("double").alias("x"))


def track_boxes(spark, d) -> tuple[DataFrame, DataFrame]:
    """(truth, predictions) of 16 sequences from user_frames: predictions lose some rows and swap some ids.

    Every track of a sequence has a place of its own, so that no assignment is a tie.
    """
    rows = user_frames(spark, d)
    place = F.floor(F.col("track_id") / 16) * 30.0
    box = [place.alias("x1"), F.lit(0.0).alias("y1"), (place + 20).alias("x2"), F.lit(20.0).alias("y2")]
    gt = rows.select((F.col("track_id") % 16).alias("seq"), "frame", "track_id", *box, F.lit(False).alias("ign"))
    kept = rows.where(F.pmod(F.col("frame") * 7 + F.col("track_id"), F.lit(9)) != 0)
    renamed = F.when(F.pmod(F.col("frame"), F.lit(5)) == 0, F.col("track_id") + 100_000).otherwise(F.col("track_id"))
    pred = kept.select((F.col("track_id") % 16).alias("seq"), "frame", renamed.alias("track_id"), (place + F.pmod(F.col("frame"), F.lit(4))).alias("x1"), F.lit(0.0).alias("y1"), (place + 20 + F.pmod(F.col("frame"), F.lit(4))).alias("x2"), F.lit(20.0).alias("y2"))
    return gt, pred


def manifest(spark, d) -> DataFrame:
    """Orders as frames of 16 scenes."""
    o = table(pin(spark), d, "orders")
    light = F.when(F.col("o_orderpriority").startswith("1"), "night").when(F.col("o_orderpriority").startswith("2"), "dusk").otherwise("day")
    split = F.element_at(F.array(F.lit("train"), F.lit("train"), F.lit("val"), F.lit("test")), (F.col("o_custkey") % 4 + 1).cast("int"))
    return o.select(
        F.col("o_orderkey").cast("long").alias("image_id"), F.concat(F.lit("s"), (F.col("o_custkey") % 16).cast("string")).alias("scene_id"),
        F.concat(F.lit("v"), (F.col("o_custkey") % 48).cast("string")).alias("source_video"), light.alias("lighting"), split.alias("split"), F.lit("unknown").alias("occlusion"), (F.col("o_orderkey") % 7).alias("n_objects"),
    )

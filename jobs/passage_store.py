"""Keeps a store of the passages of a growing folder of documents, each passage text once.

    python jobs/passage_store.py --documents IN --output OUT --checkpoint MARK [--set files_per_batch=100]

For those who answer questions from a corpus: what is indexed and embedded are passages, and each
should be embedded once. A run takes the files that have come into the folder since the last one (a
file stream with a checkpoint, all that is available, then it ends), cuts their texts into lines,
drops noise, and adds the passages whose content the store does not hold yet.

    OUT/passages/batch=B/lang=L   doc_id, passage_no, text, token_count, sha
    OUT/report/batch=B            lang, documents, passages, noise, stored, tokens

A batch that was cut short is done again from its files and replaces its own partitions; it looks
only at earlier batches, so that it comes to the same rows. Within a batch the smallest
(doc_id, passage_no) owns a text, across batches the earliest batch does. A file that changes under
an old name is not read again.
"""

from __future__ import annotations

import os
import sys

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from jobs import common
from siftwork.functions import text as T

PASSAGES = "doc_id long, passage_no int, text string, token_count long, sha string, batch long, lang string"
REPORT = "lang string, documents long, passages long, noise long, stored long, tokens long, batch long"


def passages(docs: DataFrame, settings: dict) -> DataFrame:
    """(doc_id, lang, passage_no, text, noise): the lines of every text, white space collapsed, blank ones left out; null text has none."""
    lines = F.filter(F.transform(F.split(T.collapse_whitespace(F.col("text")), "\n"), lambda line: F.trim(line)), lambda line: line != "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.posexplode(lines).alias("passage_no", "text"))
    return rows.withColumn("noise", T.is_noise(F.col("text"), settings["least_chars"], settings["most_marks"]))


def not_stored(fresh: DataFrame, known: DataFrame, few: int) -> DataFrame:
    """Rows of `fresh` (one for each sha) whose sha is not in `known`.

    The store is only scanned, for its hashes, while the batch's own are at most `few` and can be
    broadcast; a larger batch is joined with it by a shuffle.
    """
    own = fresh.select("sha")
    held = known.join(F.broadcast(own), "sha", "left_semi").distinct() if own.limit(few + 1).count() <= few else known
    return fresh.join(held, "sha", "left_anti")


def store_batch(docs: DataFrame, batch: int, output: str, settings: dict) -> None:
    """Add the rows of one batch; doing it again gives the same."""
    spark = docs.sparkSession
    every = passages(docs, settings)
    rest = ["doc_id", "passage_no", "lang", "text"]
    first = every.where("not noise").withColumn("sha", F.sha2("text", 256)).groupBy("sha").agg(F.min(F.struct(*rest)).alias("_first")).select("sha", "_first.*")
    first = first.persist(StorageLevel.MEMORY_AND_DISK)  # recomputed from the batch's files if an executor is lost
    try:
        new = first
        if batch > 0:
            new = not_stored(first, stored(spark, output).where(F.col("batch") < batch).select("sha"), settings["few_keys"])
        new = new.select("doc_id", "passage_no", "text", T.count_tokens(F.col("text")).alias("token_count"), "sha", F.lit(batch).cast("long").alias("batch"), "lang")
        common.replace_partitions(new, f"{output}/passages", ["batch", "lang"])
    finally:
        first.unpersist()
    counts = [F.count("passage_no").alias("passages"), F.coalesce(F.count_if("noise"), F.lit(0)).alias("noise")]
    found = docs.groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count("*").alias("documents"))
    lines = every.groupBy("lang").agg(*counts)
    added = stored(spark, output).where(F.col("batch") == batch).groupBy("lang").agg(F.count("*").alias("stored"), F.sum("token_count").alias("tokens"))
    for side in (lines, added):
        found = found.alias("f").join(side.alias("s"), F.col("f.lang").eqNullSafe(F.col("s.lang")), "left").drop(F.col("s.lang"))
    numbers = ("documents", "passages", "noise", "stored", "tokens")
    report = found.select("lang", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers], F.lit(batch).cast("long").alias("batch"))
    common.replace_partitions(report, f"{output}/report", ["batch"])
    total = reports(spark, output).where(F.col("batch") == batch).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in numbers]).first()
    common.log.info("batch %d: read %d documents, %d passages, %d of them noise; wrote %d passages, %d tokens, to %s", batch, *total, output)


def stored(spark: SparkSession, output: str) -> DataFrame:
    """All passages of the store."""
    return spark.read.schema(PASSAGES).parquet(f"{output}/passages")


def reports(spark: SparkSession, output: str) -> DataFrame:
    """One row for each batch and language."""
    return spark.read.schema(REPORT).parquet(f"{output}/report")


def pattern(path: str) -> str:
    """The same path as a pattern: of those, the file stream takes a single file as well as a folder."""
    if any(c in path for c in "*?[]{}"):
        return path
    head, slash, name = path.rstrip("/").rpartition("/")
    return f"{head}{slash}{{{name}}}"


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, settings: dict | None = None) -> None:
    """Take what is new in `documents` (Parquet with doc_id, lang, text) into the store."""
    settings = common.settings_of("passage_store", settings)
    source = spark.readStream.schema(spark.read.parquet(documents).schema)
    if settings["files_per_batch"]:
        source = source.option("maxFilesPerTrigger", settings["files_per_batch"])
    docs = source.parquet(pattern(documents)).select("doc_id", "lang", "text")
    write = docs.writeStream.foreachBatch(lambda batch, number: store_batch(batch, number, output, settings))
    stream = write.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        stream.awaitTermination()
    finally:
        stream.stop()
    done = stream.lastProgress
    common.log.info("%s: nothing new" if done is None or not done["numInputRows"] else "%s: up to date", documents)


if __name__ == "__main__":
    common.main("passage_store", "Adds the passages of new documents to a store.", ["documents", "output", "checkpoint"], run)

"""A stored lexical index: the parts of BM25 scores as Parquet tables, read for the terms of a question only.

    PATH/facts    one row: fingerprint, ranges, documents
    PATH/terms    term, idf
    PATH/blocks   by bucket of the term: term, range, most, ids, parts (without the idf)

Documents fall by hash into ranges of about RANGE_DOCS. A block holds what a term adds to the
documents of one range, and the most that it adds to one. A search adds up these maxima: a range
whose sum does not reach the k-th best score that a few promising ranges already give is left out
with all its blocks, which changes no result; only blocks of the others are opened.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.functions import text as T
from siftwork.operators import retrieval
from siftwork.session import spread, written

RANGE_DOCS, BUCKETS = 256, 64
#: Documents a task for each bucket.
TASK_DOCS = 500_000
#: Ranges that are scored first, to find the score to beat; and how far a bound may be off by rounding.
PROBES, SLACK = 4, 1e-5
SETTINGS = {"k1": 1.5, "b": 0.75, "epsilon": 0.25, "stopwords": True}


def fingerprint(docs: DataFrame, settings: dict | None = None) -> str:
    """A digest of the settings and of all (id, text), whatever their order."""
    row = F.struct("id", "text")
    halves = [F.sum(F.xxhash64(row, F.lit(k)).cast("decimal(38,0)")) for k in (0, 1)]
    found = docs.agg(F.count("*").alias("n"), *[h.alias(f"h{k}") for k, h in enumerate(halves)])
    named = json.dumps(SETTINGS | (settings or {}), sort_keys=True)
    return found.select(F.sha2(F.concat_ws("|", F.lit(named), "n", "h0", "h1"), 256)).first()[0]


def bucket_of(term: str) -> Column:
    """By the hash of Spark's own partitioning, so that a task that has its terms writes into one bucket."""
    return F.pmod(F.hash(term), F.lit(BUCKETS)).cast("int")


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, range, id, tf, dl) of batches of (id, range, tokens): a document's terms are counted where it is read."""
    for batch in batches:
        size = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
        coded = batch.column(2).flatten().dictionary_encode()
        many = max(len(coded.dictionary), 1)
        pair, tf = np.unique(np.repeat(np.arange(len(size)), size) * many + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        doc, term = np.divmod(pair, many)
        own = pa.array(doc)
        columns = [coded.dictionary.take(pa.array(term)), batch.column(1).take(own), batch.column(0).take(own), pa.array(tf, pa.int64()), pa.array(size[doc], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["term", "range", "id", "tf", "dl"])


def write(docs: DataFrame, path: str, settings: dict | None = None) -> str:
    """Index (id, text) into a folder, replacing what is there; returns the fingerprint. Null texts have no terms."""
    s = SETTINGS | (settings or {})
    mark = fingerprint(docs, settings)
    tokens = spread(docs).select("id", F.coalesce(T.tokenize(F.col("text"), s["stopwords"]), F.array().cast("array<string>")).alias("tokens"))
    n, (counts, mean) = docs.count(), retrieval.term_counts(tokens)
    ranges = max(1, -(-n // RANGE_DOCS))
    raw = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    floor = (counts.agg(F.avg(raw)).first()[0] or 0.0) * s["epsilon"]
    counts.select("term", F.when(raw < 0, floor).otherwise(raw).alias("idf")).write.mode("overwrite").parquet(f"{path}/terms")
    post = tokens.select("id", F.pmod(F.xxhash64("id"), F.lit(ranges)).alias("range"), "tokens").mapInArrow(_postings, f"term string, range long, id {docs.schema['id'].dataType.simpleString()}, tf long, dl long")
    part = F.col("tf") * (s["k1"] + 1) / (F.col("tf") + s["k1"] * (1 - s["b"] + s["b"] * F.col("dl") / mean))
    # The one shuffle of all postings: tasks hold whole buckets' shares. A range has about RANGE_DOCS documents, so that no list grows with the table.
    parts = post.select("term", "range", F.struct("id", part.alias("part")).alias("p")).repartition(BUCKETS * -(-max(n, 1) // TASK_DOCS), "term")
    blocks = parts.groupBy("term", "range").agg(F.array_sort(F.collect_list("p")).alias("p"), F.max("p.part").alias("most"))
    blocks = blocks.select("term", "range", "most", F.col("p.id").alias("ids"), F.col("p.part").alias("parts"), bucket_of("term").alias("bucket"))
    blocks.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks")
    facts = docs.sparkSession.range(1).select(F.lit(mark).alias("fingerprint"), F.lit(ranges).cast("long").alias("ranges"), F.lit(n).alias("documents"), F.lit(s["stopwords"]).alias("stopwords"))
    facts.coalesce(1).write.mode("overwrite").parquet(f"{path}/facts")
    return mark


BLOCKS = "term string, range long, most double, ids array<long>, parts array<double>, bucket int"


class Index:
    """A stored index, opened for a fingerprint; another one is an error."""

    def __init__(self, spark: SparkSession, path: str, mark: str):
        facts = spark.read.parquet(f"{path}/facts").first()
        if facts is None or facts["fingerprint"] != mark:
            raise ValueError(f"stale index at {path}: made for {facts and facts['fingerprint']}, wanted {mark}")
        self.stopwords = facts["stopwords"]
        self.terms = spark.read.schema("term string, idf double").parquet(f"{path}/terms")
        self.blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")

    def _hits(self, queries: DataFrame) -> DataFrame:
        """Blocks of the terms that are asked: (qid, qn, range, most, ids, parts); qn is the count in the question times the idf."""
        asked = queries.select("qid", F.explode(T.tokenize(F.col("text"), self.stopwords)).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qn"))
        few = asked.limit(200_001).count() <= 200_000
        sent = F.broadcast if few else lambda side: side
        weighed = written(self.terms.join(sent(asked), "term").select("qid", "term", (F.col("qn") * F.col("idf")).alias("qn"), bucket_of("term").alias("bucket")), "asked")
        return self.blocks.join(sent(weighed), ["bucket", "term"]).select("qid", "qn", "range", "most", "ids", "parts")

    @staticmethod
    def _scored(hits: DataFrame) -> DataFrame:
        # A document has one range: blocks meet as they are, and open where they have met.
        each = hits.repartition("qid", "range").select("qid", "range", "qn", F.explode(F.arrays_zip("ids", "parts")).alias("p"))
        return each.groupBy("qid", "range", F.col("p.ids").alias("id")).agg(F.round(F.sum(F.col("qn") * F.col("p.parts")), 6).alias("score")).where("score > 0").select("qid", "id", "score")

    def ranges(self, hits: DataFrame, k: int) -> DataFrame:
        """(qid, range) that may hold one of the k best: all but those whose maxima do not add up to it."""
        bound = hits.groupBy("qid", "range").agg(F.sum(F.greatest(F.col("qn") * F.col("most"), F.lit(0.0))).alias("bound"))
        first = retrieval.ranked(bound, PROBES, "bound", tie="range").select("qid", "range")
        kth = retrieval.ranked(self._scored(hits.join(first, ["qid", "range"])), k).where(F.col("rank") == k).select("qid", F.col("score").alias("_least"))
        return bound.join(kth, "qid", "left").where(F.col("bound") >= F.coalesce("_least", F.lit(0.0)) - SLACK).select("qid", "range")

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """(qid, id, score, rank): the k best of each question (qid, text), as bm25() over the documents gives them."""
        hits = self._hits(queries)
        return retrieval.ranked(self._scored(hits.join(self.ranges(hits, k), ["qid", "range"])), k)

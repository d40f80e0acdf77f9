"""Product codes of integer vectors: k-means codebooks by treeAggregate over columnar blocks.

The vectors are cut into equal parts; each part position has a codebook of integer entries. The
kept rows are written once as blocks: the ids, the labels and one contiguous run of numbers for
each dimension. A round is one treeAggregate over the blocks: the distances of a block's parts to
all entries grow dimension by dimension, np.add.at adds each part to its entry's sums and counts,
and these int64 tensors, whose size only depends on the codebooks, meet in a reduction tree.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.llm import common

#: Numbers of a block at most, unless a single row has more; vectors that meet the entries at once.
BLOCK_CELLS, STRIP = 1 << 19, 512
#: Partitions that one node of the reduction tree may gather.
FAN_IN = 32


def finite(x: Column) -> Column:
    """Whether a vector is there and holds neither null nor a number that is not finite."""
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == F.lit(float("inf"))))
    return x.isNotNull() & ~bad


def _blocks(rows: DataFrame, dims: int, kind: str) -> DataFrame:
    """(n, ids, labels, cells): rows as blocks, cells holding dims runs of n numbers of type `kind`."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BLOCK_CELLS // max(1, dims))
        for batch in batches:
            for low in range(0, batch.num_rows, step):
                part = batch.slice(low, step)
                lists = part.column(2)
                size = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
                cells = np.zeros((part.num_rows, dims), kind)
                cells[np.arange(dims)[None, :] < size[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
                one = np.array([0, part.num_rows], np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part.num_rows], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(one), pa.concat_arrays([part.column(0)])),
                        pa.ListArray.from_arrays(pa.array(one), pa.concat_arrays([part.column(1)])),
                        pa.array([np.ascontiguousarray(cells.T).tobytes()], pa.binary()),
                    ],
                    ["n", "ids", "labels", "cells"],
                )

    return rows.select("vec_id", "_label", "_v").mapInArrow(kernel, "n long, ids array<long>, labels array<string>, cells binary")


class Codebooks:
    """books[p]: the integer entries of part position p, one row each."""

    def __init__(self, books: np.ndarray):
        self.books = books
        self.parts, self.entries, self.width = books.shape

    def nearest(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, squared distance) of each part; cells: (dims, n). Ties: lower index."""
        n = cells.shape[1]
        index, error = np.zeros((self.parts, n), np.int64), np.zeros((self.parts, n), np.int64)
        widest = int(max(np.abs(cells).max(initial=0), np.abs(self.books).max(initial=0)))
        kind = np.int32 if self.width * (2 * widest) ** 2 < 2**31 else np.int64
        books, cells = self.books.astype(kind), cells.astype(kind)
        for low in range(0, n, STRIP):
            strip = cells[:, low : low + STRIP]
            for p in range(self.parts):
                distance = np.zeros((strip.shape[1], self.entries), kind)
                for d in range(self.width):
                    away = strip[p * self.width + d][:, None] - books[p, :, d][None, :]
                    away *= away
                    distance += away
                best = distance.argmin(axis=1)
                index[p, low : low + STRIP] = best
                error[p, low : low + STRIP] = distance[np.arange(len(best)), best]
        return index, error

    def gather(self, sums, cells: np.ndarray):
        """`sums` = (sums by part, dimension and entry; counts by part and entry) with a block's parts added."""
        if sums is None:
            sums = np.zeros((self.parts, self.width, self.entries), np.int64), np.zeros((self.parts, self.entries), np.int64)
        index, _ = self.nearest(cells)
        for p in range(self.parts):
            np.add.at(sums[1][p], index[p], 1)
            for d in range(self.width):
                np.add.at(sums[0][p, d], index[p], cells[p * self.width + d])
        return sums

    def moved(self, sums) -> Codebooks:
        """Entries at the floor of their parts' mean; those without parts stay."""
        total, count = sums[0].transpose(0, 2, 1), sums[1][:, :, None]
        return Codebooks(np.where(count > 0, np.floor_divide(total, np.maximum(count, 1)), self.books))

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.reshape(-1).tolist())).encode()).hexdigest()


def _both(a, b):
    """Sum of two pairs of tensors, either of which may be missing."""
    if a is None or b is None:
        return b if a is None else a
    return a[0] + b[0], a[1] + b[1]


def trained(blocks: DataFrame, first: Codebooks, rounds: int, kind: str) -> Codebooks:
    """The codebooks after `rounds` rounds over all blocks."""
    dims, books = first.parts * first.width, first
    cells = blocks.select("n", "cells").rdd
    depth = max(2, math.ceil(math.log(max(2, cells.getNumPartitions()), FAN_IN)))
    for _ in range(rounds):
        now = books
        sums = cells.treeAggregate(None, lambda acc, row, now=now: now.gather(acc, np.frombuffer(row.cells, kind).reshape(dims, row.n)), _both, depth)
        books = now if sums is None else now.moved(sums)
    return books


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each usable row of (vec_id, embedding, label).

    Rows whose vector is null or holds null or non-finite components are left out. Components are
    floor(scale * x). A vector shorter than the longest, or whose length is no multiple of `parts`,
    counts as filled up with zeros. The codebooks start as the parts of the rows with the `entries`
    smallest vec_ids (null ids last, equal ids by vector); with fewer rows, there are fewer entries.
    `code` has two hex digits for each part (`entries` is at most 256). Repeated rows are rows of
    their own. label_error sums the errors over rows with an equal label, nulls together. An empty
    table gives no rows. Numbers whose sums or distances might not fit 64 bits are an error.
    """
    if not 1 <= entries <= 256 or parts < 1 or rounds < 0:
        raise ValueError("entries must be 1 to 256, parts at least 1, rounds at least 0")
    scratch = common.Scratch(vectors.sparkSession)
    x = F.col("embedding")
    rows = vectors.where(finite(x)).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("string").alias("_label"),
        F.transform(x, lambda e: F.floor(e.cast("double") * scale)).alias("_v"),
        F.coalesce(F.array_max(F.transform(x, lambda e: F.abs(e.cast("double") * scale))), F.lit(0.0)).alias("_widest"),
    )
    facts = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("_v")), F.lit(0)).alias("dims"), F.max("_widest").alias("widest")).first()
    width = max(1, -(-facts["dims"] // parts))
    dims, widest = width * parts, (facts["widest"] or 0.0) + 1
    if max(dims * (2 * widest) ** 2, widest * facts["n"]) >= 2.0**62:
        raise ValueError("distances or sums of these vectors may not fit 64 bits")
    kind = next(k for k, most in (("<i2", 2**15), ("<i4", 2**31), ("<i8", 2**63)) if widest < most)
    head = rows.orderBy(F.col("vec_id").asc_nulls_last(), "_v").limit(entries).select("_v").collect()
    books = np.zeros((parts, len(head), width), np.int64)
    for k, row in enumerate(head):
        flat = np.zeros(dims, np.int64)
        flat[: len(row["_v"])] = row["_v"]
        books[:, k] = flat.reshape(parts, width)
    blocks = scratch.keep(_blocks(rows, dims, kind))
    final = trained(blocks, Codebooks(books), rounds, kind)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                n = batch.column(0)[k].as_py()
                index, error = final.nearest(np.frombuffer(batch.column(3)[k].as_buffer(), kind).reshape(dims, n))
                digits = index.T.astype(np.uint8).tobytes().hex()
                code = [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(k, 1).flatten(), batch.column(2).slice(k, 1).flatten(), pa.array(code, pa.string()), pa.array(error.sum(axis=0), pa.int64())],
                    ["vec_id", "_label", "code", "error"],
                )

    out = scratch.keep(blocks.mapInArrow(coded, "vec_id long, _label string, code string, error long"))
    # The sums by label: one row for each; the few labels of many rows are broadcast, others join by a shuffle.
    named = out.withColumn("_none", F.col("_label").isNull()).withColumn("_label", F.coalesce("_label", F.lit("")))
    totals = scratch.keep(named.groupBy("_label", "_none").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
    joined = common.dealt_join(named, totals, ["_label", "_none"], facts["n"])
    return scratch.tie(joined.select("vec_id", "code", "error", "label_error", F.lit(final.digest()).alias("codebooks_sha256")))

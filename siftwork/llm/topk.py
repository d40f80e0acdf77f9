"""Exact top-k inner products with an impact-ordered index, processed score at a time.

Each part of the vectors holds posting segments: the (vector, sign) pairs of one dimension whose
quantised impact |x| // STEP is the same. Segments are taken in rounds of falling impact. After a
round, a vector's score lies within bounds: what is added is short by less than STEP per posting,
what is missing has less impact than the round. A query stops when the number of vectors whose
upper bound reaches its k-th lower bound is small, or when the segments end; these possible
members, which provably hold the answer, are scored exactly in 64-bit integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Width of an impact level.
STEP = 4
#: Vectors of a part, queries of a block and vectors of one index in a part.
PART_ROWS, QUERY_ROWS, INDEX_ROWS = 131_072, 4_096, 4_096
PARTS_AT_LEAST = 48
#: Possible members of a query at which it is cheaper to score than to go on.
FEW = 24


class ImpactIndex:
    """Posting segments of a block of integer vectors, largest impact first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        # Of equal vectors only the k + 1 smallest ids can be among k results (one may be the query's),
        # each in at most k rows.
        order = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[order], vectors[order]
        place = np.arange(len(ids))
        fresh = np.ones(len(ids), bool)
        fresh[1:] = (vectors[1:] != vectors[:-1]).any(axis=1)
        other = fresh.copy()
        other[1:] |= ids[1:] != ids[:-1]
        number = np.cumsum(other)  # of the (vector, id)
        keep = (place - np.maximum.accumulate(np.where(other, place, 0)) < k) & (number - np.maximum.accumulate(np.where(fresh, number, 0)) <= k)
        self.ids, self.vectors = ids[keep], vectors[keep]
        # Rows of the id with most of them: so many places a query's own rows may take.
        self.most = int(np.unique(self.ids, return_counts=True)[1].max(initial=1))
        size = np.abs(self.vectors)
        level = (size // STEP).astype(np.int64)
        vec, dim = np.nonzero(size)
        impact = level[vec, dim]
        by = np.lexsort((vec, dim, -impact))
        self.vec, self.dim, self.impact = vec[by], dim[by], impact[by]
        self.sign = np.sign(self.vectors[self.vec, self.dim])
        top = int(self.impact[0]) if len(self.impact) else 0
        self.rounds = [top + 1, *[r for r in (24, 16, 11, 8, 6, 4, 3, 2, 1) if r <= top], 0]

    def possible(self, queries: np.ndarray, k: int, kind: type) -> list[np.ndarray]:
        """For each query, positions of all vectors that may be among its k best."""
        n, dims = self.vectors.shape
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(queries)
        going = np.arange(len(queries))
        q = queries.astype(kind)
        weight = np.abs(q)
        total = weight.sum(axis=1)
        score = np.zeros((len(q), n), kind)
        seen = np.zeros((n, dims), kind)
        # Rounding of sums in floating point, far above its true size.
        slip = total * float(np.abs(self.vectors).max(initial=0)) * dims * np.finfo(kind).eps * 4
        at = 0
        for floor in self.rounds[1:]:
            end = int(np.searchsorted(-self.impact, -floor, side="right"))
            if end > at:
                plane = np.zeros((n, dims), kind)
                v, d = self.vec[at:end], self.dim[at:end]
                plane[v, d] = self.sign[at:end] * self.impact[at:end] * STEP
                seen[v, d] = 1
                score[going] += q[going] @ plane.T
                at = end
            # Missing postings have |x| <= floor * STEP - 1, seen ones are short by STEP - 1 at most.
            miss = max(floor * STEP - 1, 0)
            part = weight[going] @ seen.T
            slack = part * (STEP - 1) + (total[going][:, None] - part) * miss + slip[going][:, None]
            low = score[going] - slack
            kth = np.partition(low, n - k, axis=1)[:, n - k] if n > k else np.full(len(going), -np.inf)
            may = score[going] + slack >= kth[:, None]
            count = may.sum(axis=1)
            stop = (count <= max(FEW, 2 * k)) | (at == len(self.vec))
            for r in np.flatnonzero(stop).tolist():
                out[going[r]] = np.flatnonzero(may[r])
            going = going[~stop]
            if not len(going):
                break
        else:
            if len(going):  # no postings at all: every vector is zero
                for r in going.tolist():
                    out[r] = np.arange(n)
        return out

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, vector id, score) of the k best other rows of this block for each query."""
        top = float(np.abs(self.vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * self.vectors.shape[1]
        kind = np.float32 if top < 1e9 else np.float64
        # The query's own rows may take places before k others; few ids are in more than one row.
        found = self.possible(queries, min(k + self.most, len(self.ids)), kind)
        own = np.repeat(np.arange(len(ids)), [len(f) for f in found])
        at = np.concatenate(found) if found else np.zeros(0, np.int64)
        score = np.empty(len(at), np.int64)
        for low in range(0, len(at), 65536):
            part = slice(low, low + 65536)
            score[part] = (queries[own[part]] * self.vectors[at[part]]).sum(axis=1)
        who, vec = ids[own], self.ids[at]
        keep = who != vec
        who, vec, score, own = who[keep], vec[keep], score[keep], own[keep]
        order = np.lexsort((vec, -score, own))
        own, who, vec, score = own[order], who[order], vec[order], score[order]
        first = np.searchsorted(own, own, side="left")
        best = np.arange(len(own)) - first < k
        return who[best], vec[best], score[best]


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Integer vectors as rows, shorter ones filled with zeros."""
    column = column.combine_chunks()
    length = pa.compute.list_value_length(column).to_numpy()
    out = np.zeros((len(length), dims), np.int64)
    place = np.arange(dims)[None, :] < length[:, None]
    out[place] = column.flatten().to_numpy()
    return out


def integer_vectors(df: DataFrame) -> DataFrame:
    """(vec_id, v): floor(256 * x) of each component; vectors with null or non-finite ones left out."""
    x = F.col("embedding")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == F.lit(float("inf"))))
    ok = df.where(x.isNotNull() & F.col("vec_id").isNotNull() & ~bad)
    return ok.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e.cast("double") * 256)).alias("v"))


def search(vectors: DataFrame, every: int = 50, k: int = 5, part_rows: int = PART_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows for rows with vec_id divisible by `every`.

    Ties go to the smaller vec_id. A missing component of a shorter vector counts as zero. The
    vectors are dealt by hash into parts; the queries, in blocks of about QUERY_ROWS, meet every
    part once. A part gives k rows for a query, so that the last ranking sees k rows for each part
    and not a row for each pair. Rows that share a vec_id are all candidates of others.
    Components so large that a score might not fit 64 bits are an error.
    """
    base = integer_vectors(vectors)
    widest = F.max(F.greatest(F.abs(F.array_max("v").cast("double")), F.abs(F.array_min("v").cast("double"))))
    facts = base.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("q"), widest.alias("widest")).first()
    dims = facts["dims"] or 1
    if (facts["widest"] or 0.0) ** 2 * dims >= 2.0**62:
        raise ValueError("inner products of these vectors may not fit 64 bits")
    parts = max(PARTS_AT_LEAST, -(-facts["n"] // part_rows))
    blocks = max(1, -(-facts["q"] // QUERY_ROWS))
    part = F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")
    rows = base.select(part.alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "v", F.lit(False).alias("asks"))
    block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")
    asks = base.where(F.col("vec_id") % every == 0).select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), block.alias("block"), "vec_id", "v", F.lit(True).alias("asks"))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def meet(group: pa.Table) -> pa.Table:
        flag = group.column("asks").to_numpy()
        ids, vecs = group.column("vec_id").to_numpy(), _matrix(group.column("v"), dims)
        q, v = np.flatnonzero(flag), np.flatnonzero(~flag)
        got = []
        for low in range(0, len(v), INDEX_ROWS):
            own = v[low : low + INDEX_ROWS]
            index = ImpactIndex(ids[own], vecs[own], k)
            for start in range(0, len(q), 1024):
                some = q[start : start + 1024]
                got.append(index.search(ids[some], vecs[some], k))
        if not got:
            return schema.empty_table()
        who, vec, score = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.lexsort((vec, -score, who))
        who, vec, score = who[order], vec[order], score[order]
        best = np.arange(len(who)) - np.searchsorted(who, who, side="left") < k
        return pa.table([who[best], vec[best], score[best]], schema=schema)

    found = rows.union(asks).groupBy("part", "block").applyInArrow(meet, "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

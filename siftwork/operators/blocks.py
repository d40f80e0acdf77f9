"""Vectors that meet in blocks: a part of the rows and a block of the queries are one task's matrix product.

Products by BLAS only choose; what leaves a task is summed in the order of the dimensions, as
functions.vectors does it, so that the values are the same.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a part and of a query block, and queries that are multiplied at once.
PART, BLOCK, STEP = 16_384, 4_096, 256


def whole(name: str) -> Column:
    """The vector, or null if it has nulls: pandas does not tell a null in it from NaN."""
    return F.when(~F.exists(name, lambda x: x.isNull()), F.col(name)).alias(name)


def matrix(column: pd.Series, dims: int, none: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """([n, dims], lengths): shorter vectors end in zeros, null ones are zeros of length `none`."""
    length = np.array([none if v is None else len(v) for v in column], int)
    out = np.zeros((len(column), dims))
    for n in np.unique(length[length >= 0]):
        at = np.flatnonzero(length == n)
        out[at, : min(n, dims)] = np.stack(column.iloc[at].to_numpy())[:, :dims]
    return out, length


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of the rows of a with those of b, added in order."""
    return np.cumsum(a * b, axis=1)[:, -1] if a.shape[1] else np.zeros(len(a))


def rounded(values: np.ndarray, exact: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Millionths of values up to 1000, as round(x, 6) gives them; `exact` gives the values at places that are close to a half."""
    scaled = np.abs(values) * 1e6
    out = (np.sign(values) * np.floor(scaled + 0.5)).astype(np.int64)
    near = np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-5)
    if len(near):
        out.flat[near] = [int(Decimal(repr(float(v))).quantize(Decimal("1e-6"), ROUND_HALF_UP).scaleb(6)) for v in exact(near)]
    return out


def meet(rows: DataFrame, queries: DataFrame, kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, part=None, counts: tuple[int, int] | None = None, size: int | None = None) -> DataFrame:
    """kernel(rows, queries) for each part of the rows (id, ...) and block of the queries (qid, ...): each pair meets once.

    Parts of `size` rows are by hash of the id, or `part` maps their number to a column; a row is sent once a block, a query once a part.
    Both sides are counted, unless `counts` says how many they are at most.
    """
    n, m = counts or (rows.count(), queries.count())
    parts = max(rows.sparkSession.sparkContext.defaultParallelism if n > 1000 else 1, -(-n // (size or PART)))
    blocks = max(1, -(-m // BLOCK))
    own = part(parts) if part else F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    left = rows.withColumn("_part", own).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.withColumn("_block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    sides = left.groupBy("_part", "_block").cogroup(right.groupBy("_part", "_block"))
    types = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "binary": pa.binary()}
    fields = [(c.split()[0], types[c.split()[1]]) for c in schema.split(", ")]

    def both(a: pa.Table, b: pa.Table) -> pa.Table:
        out = kernel(a.to_pandas(), b.to_pandas()) if len(a) and len(b) else None
        return pa.table({c: pa.array([] if out is None else out[c].tolist(), t) for c, t in fields})

    return sides.applyInArrow(both, schema)


def best(score: np.ndarray, raw: Callable[[int, np.ndarray], np.ndarray], ids: np.ndarray, k: int, rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each row of `score` [q, n] (NaN first, -inf not at all): (places, raw values) among which are its k best by rounded value and id.

    All that rounding could bring to the k best are kept, of equal values only those of the k smallest ids.
    """
    key = np.where(np.isnan(score), np.inf, score)
    n = key.shape[1]
    least = np.partition(key, n - k, axis=1)[:, n - k] if n > k else np.full(len(key), -np.inf)
    with np.errstate(invalid="ignore"):
        least = np.where(np.isfinite(least), least - 2e-6 - 1e-9 * np.abs(least), least)
    out = []
    for r in range(len(key)):
        at = np.flatnonzero((key[r] >= least[r]) & (key[r] > -np.inf))
        value = raw(int(rows[r]), at)
        order = np.lexsort((ids[at], -np.where(np.isnan(value), 0, value), ~np.isnan(value)))
        at, value = at[order], value[order]
        new = np.r_[True, (value[1:] != value[:-1]) & ~(np.isnan(value[1:]) & np.isnan(value[:-1]))] if len(at) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        some = np.arange(len(at)) - (first[np.cumsum(new) - 1] if len(at) else 0) < k
        out.append((at[some], value[some]))
    return out


def nearest(rows: DataFrame, queries: DataFrame, k: int, dims: int, probed: Callable | None = None) -> DataFrame:
    """(qid, id, score): for each query (qid, qvec) of rows (id, vec) those among which are its k best inner products.

    probed(a, b), if given, says which rows of a each row of b takes: [len(b), len(a)]. Vectors of different lengths, or with nulls, have no score.
    """
    kind = rows.schema["id"].dataType.simpleString(), queries.schema["qid"].dataType.simpleString()

    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, length = matrix(left.vec, dims)
        b, asked = matrix(right.qvec, dims, -2)
        ids, qids, found = (*(np.asarray(x, object if x.dtype.kind not in "iuf" else x.dtype) for x in (left.id, right.qid)), [])
        place = np.unique(ids, return_inverse=True)[1]  # ids may be strings
        smallest = np.argsort(place, kind="stable")
        for low in range(0, len(b), STEP):
            q = np.arange(low, min(low + STEP, len(b)))
            with np.errstate(all="ignore"):
                score = b[q] @ a.T
            takes = probed(a, length == dims, b[q], asked[q] == dims) if probed else np.ones((1, len(a)), bool)
            takes = np.broadcast_to(takes, score.shape)
            same = asked[q][:, None] == length[None]
            score[~(takes & same)] = -np.inf
            for r, (at, value) in zip(q, best(score, lambda r, at: dots(a[at], b[[r]]), place, k, q), strict=True):
                found.append((qids[np.full(len(at), r)], ids[at], value, np.where(np.isnan(value), 2, 1)))
            for r in q[~same.all(axis=1)]:
                none = smallest[(takes[r - low] & ~same[r - low])[smallest]][:k]
                found.append((qids[np.full(len(none), r)], ids[none], np.zeros(len(none)), np.zeros(len(none), int)))
        q, i, v, has = (np.concatenate(x) for x in zip(*found, strict=True))
        return pd.DataFrame({"qid": pd.Series(q, dtype=qids.dtype), "id": pd.Series(i, dtype=ids.dtype), "score": v, "has": has})  # pandas has one value for null and NaN

    met = meet(rows.select("id", whole("vec")), queries.select("qid", whole("qvec")), kernel, f"qid {kind[1]}, id {kind[0]}, score double, has long")
    return met.select("qid", "id", F.when(F.col("has") == 2, F.lit(float("nan"))).when(F.col("has") == 1, F.col("score")).alias("score"))

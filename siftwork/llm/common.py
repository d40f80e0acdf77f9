"""What the operators share: Arrow batches, scratch tables, byte-level word scanning."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute is used below
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one step of a vectorised kernel looks at; bounds a worker's memory.
SLICE_BYTES = 1 << 20
#: Rows whose keys may be broadcast: 8 bytes each, so 16 MB at most. Above it, joins shuffle.
BROADCAST_ROWS = 2_000_000
#: A key is hot that more than one in HOT rows have; so there are fewer than HOT of them.
HOT = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Return what a task has freed to the machine: a Python worker lives on, beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def arrow_map(df: DataFrame, kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow that gives its memory back; Spark bounds a batch by bytes, keep() more closely."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from kernel(batches)
        give_back()

    return df.mapInArrow(tidy, schema)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of consecutive rows with about `limit` bytes in `column`; a longer row comes alone."""
    size = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(size)
    start = 0
    while start < batch.num_rows:
        base = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end


def texts_of(column: pa.Array) -> list[str]:
    """The strings of a column, null as empty."""
    return pa.compute.fill_null(column, "").to_pylist()


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows end to end, and the rows' n + 1 offsets; null as empty."""
    column = pa.compute.fill_null(column, "").cast(pa.large_string())
    column = pa.concat_arrays([column])  # drops the offset of a slice
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in rising order, by a sort; many times the speed of np.unique, which hashes."""
    x = np.sort(x)
    keep = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    return x[keep]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
#: Bytes of a block of words, so that its running sums stay in the cache; powers of the base and of its inverse for one block.
_BLOCK = 1 << 15


def _powers(base: int, n: int = 2 * _BLOCK) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS, _INVERSES = _powers(_BASE), _powers(_INVERSE)


def translated(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """table[data] for bytes; many times the speed of an index."""
    return np.frombuffer(bytearray(data.tobytes().translate(table.tobytes())), table.dtype)


def spans_of(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and row of every word, a run of bytes in `member`; a word ends at the end of its row."""
    inside = translated(data, member)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    row_starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[row_starts] = inside[row_starts]
    start = np.flatnonzero(begins)
    inside[:-1] &= begins[1:] | ~inside[1:]  # from here on: a word's last byte
    counts = np.diff(np.searchsorted(start, offsets))
    return start, np.flatnonzero(inside) + 1, np.repeat(np.arange(len(counts)), counts)


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Hashes of the spans of bytes, mapped by `fold`, and for each of `prefixes` of their first so many bytes.

    A polynomial in an odd base, mod 2^64: running sums over all bytes are taken once, and a span's
    difference of two is brought down to its first byte by the inverse of the base.
    """
    codes = translated(data, fold)
    out = [np.empty(len(start), np.uint64) for _ in range(1 + len(prefixes))]
    cuts = np.searchsorted(start, np.arange(0, len(data) + _BLOCK, _BLOCK)).tolist()
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a == b:
            continue
        low, high = int(start[a]), int(end[b - 1])
        n = high - low
        powers, inverses = (_POWERS, _INVERSES) if n <= len(_POWERS) else (_powers(_BASE, n), _powers(_INVERSE, n))
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        part = total[1:]
        np.add(codes[low:high], np.uint64(1), out=part)
        part *= powers[:n]
        np.cumsum(part, out=part)
        first, last = start[a:b] - low, end[a:b] - low
        base, down = total[first], inverses[first]
        out[0][a:b] = mix64((total[last] - base) * down + (last - first).astype(np.uint64))
        for k, p in enumerate(prefixes, 1):
            out[k][a:b] = mix64((total[np.minimum(first + p, last)] - base) * down + np.uint64(p << 32))
    return tuple(out)


def words_of(data: np.ndarray, offsets: np.ndarray, member: np.ndarray, fold: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple:
    """Hashes of the words (runs of bytes in `member`, mapped by `fold`), the row of each, and for
    each of `prefixes` the hashes of the words' first so many bytes.

    64-bit polynomial hashes, mixed: two different words of a corpus with 10^9 distinct words
    collide with a chance near 0.03 in all.
    """
    start, end, row = spans_of(data, offsets, member)
    hashed, *more = hash_spans(data, start, end, fold, prefixes)
    return hashed, row, *more


def ascii_lower() -> np.ndarray:
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    return fold


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares. Where it is unset: on one machine a temporary one, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="siftwork-")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: While a table is written: its shuffle files go when it ends, and Arrow batches are at most 2 MB.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(2 << 20)}


class Scratch:
    """Tables written under the shared checkpoint folder.

    They stay until free() or release() is called, or Spark ends. What a result reads is not freed,
    so that frames derived from it work as long as the session does; release(df) lets go of it.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.n = spark, f"{checkpoint_dir(spark)}/siftwork-{uuid.uuid4().hex}", 0
        self._at = {}
        self._files = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._files.mkdirs(self._path(self.path))
        self._files.deleteOnExit(self._path(self.path))

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def keep(self, df: DataFrame) -> DataFrame:
        """Write `df` and read it back: lineage ends here, lost executors cost no recomputation, and shuffle files go."""
        self.n += 1
        path, conf = f"{self.path}/{self.n}", self.spark.conf
        before = {k: conf.get(k, None) for k in _WRITING}
        try:
            for k, v in _WRITING.items():
                conf.set(k, v)
            df.write.parquet(path)
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._at[id(out)] = (out, path)
        return out

    def free(self, *tables: DataFrame) -> None:
        """Remove tables of keep() that nothing reads any more."""
        for df in tables:
            self._files.delete(self._path(self._at.pop(id(df))[1]), True)

    def release(self) -> None:
        """Remove all tables."""
        self._at.clear()
        self._files.delete(self._path(self.path), True)

    def tie(self, df: DataFrame) -> DataFrame:
        """Name these tables as read by `df`, for release()."""
        df._siftwork_scratch = self
        return df


def release(*results: DataFrame) -> None:
    """Remove the tables that results of operators read, once they have been used."""
    for df in results:
        scratch = getattr(df, "_siftwork_scratch", None)
        if scratch is not None:
            scratch.release()


def small_join(df: DataFrame, ids: DataFrame, key: str, how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a side that is broadcast only if it was counted and has at most `most` rows."""
    few = ids.limit(most + 1).count() <= most
    return df.join(F.broadcast(ids) if few else ids, key, how)


def _hot(table: DataFrame, total: int) -> F.Column:
    """Of a table with the number n of rows that have its key: whether the key is hot."""
    return F.col("n") > F.lit(max(256, total // HOT))


def dealt_join(rows: DataFrame, table: DataFrame, keys: list[str], total: int) -> DataFrame:
    """rows joined with `table` (one row a key; n rows of `rows` have it) on keys that may be hot.

    The fewer than HOT rows of `table` with hot keys are broadcast, the others join by a shuffle.
    """
    hot = F.broadcast(table.where(_hot(table, total)))
    rest = rows.join(hot.select(*keys), keys, "left_anti")
    return rows.join(hot, keys).unionByName(rest.join(table.where(~_hot(table, total)), keys))


def batch_of(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type, from_pandas=False) for c, f in zip(columns, schema, strict=True)], schema=schema)

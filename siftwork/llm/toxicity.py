"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm import common

#: log2 of the number of weights; 2^20 * 4 bytes bounds what a broadcast could hold, L1 leaves a few hundred.
BITS = 20
#: Bytes of the beginnings of words that are features beside whole words, largest first.
PREFIXES = (5, 4)
#: Labelled rows used for training: those with the smallest hashes of doc_id.
MOST_LABELLED = 12_000
#: Features of them that the training task holds, of 4 bytes each.
MOST_FEATURES = 1 << 26
ALPHA, BETA, L1, L2 = 0.3, 1.0, 6.0, 1.0
PASSES = 6
#: The bias without any labelled row: nothing is flagged.
NO_LABELS = -30.0


def _member() -> np.ndarray:
    """Letters, digits and all bytes of other scripts."""
    member = np.zeros(256, bool)
    member[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
    return member


def features(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of all words, beginnings, pairs and skip pairs (one or two words between)."""
    data, offsets = common.buffer_of(column)
    word, row, *starts = common.words_of(data, offsets, _member(), common.ascii_lower(), PREFIXES)
    rows, found = [row], [word]
    for s in starts:
        rows.append(row)
        found.append(s)
    for gap in (1, 2, 3):
        if len(word) > gap:
            same = row[:-gap] == row[gap:]
            pair = common.mix64(word[:-gap] * np.uint64(0x9FB21C651E98DF25) + word[gap:] + np.uint64(min(gap, 2)))
            rows.append(row[:-gap][same])
            found.append(pair[same])
    return np.concatenate(rows), (np.concatenate(found) >> np.uint64(64 - bits)).astype(np.int64)


def per_row(column: pa.Array) -> list[np.ndarray]:
    """The distinct features of each row."""
    row, feature = features(column)
    key = common.distinct((row << BITS) | feature)
    bounds = np.searchsorted(key, np.arange(len(column) + 1, dtype=np.int64) << BITS)
    key &= (1 << BITS) - 1
    return [key[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def train(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS) -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, features, weights) of the non-zero weights, by per-coordinate FTRL-proximal.

    The features are presence of a hashed n-gram. Without rows of both classes the bias alone is
    left, so that scores are the smoothed share of label 1.
    """
    n = len(labels)
    ones = int(labels.sum())
    bias = float(np.log((ones + 0.5) / (n - ones + 0.5)))
    if not ones or ones == n:
        return bias, np.zeros(0, np.int64), np.zeros(0)
    z, s = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = sb = 0.0
    offset = 0.0
    order = np.random.default_rng(7)
    for _ in range(PASSES):
        for k in order.permutation(n).tolist():
            x = rows[k]
            zx, sx = z[x], s[x]
            root = np.sqrt(sx)
            w = np.where(np.abs(zx) <= L1, 0.0, (np.sign(zx) * L1 - zx) / ((BETA + root) / ALPHA + L2))
            g = 1.0 / (1.0 + np.exp(-np.clip(bias + offset + w.sum(), -30, 30))) - float(labels[k])
            z[x] = zx + g - (np.sqrt(sx + g * g) - root) / ALPHA * w
            s[x] = sx + g * g
            zb += g - (np.sqrt(sb + g * g) - np.sqrt(sb)) / ALPHA * offset
            sb += g * g
            offset = -zb / ((BETA + np.sqrt(sb)) / ALPHA + L2)
    live = np.flatnonzero(np.abs(z) > L1)
    w = (np.sign(z[live]) * L1 - z[live]) / ((BETA + np.sqrt(s[live])) / ALPHA + L2)
    return bias + offset, live, w


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MOST_LABELLED, everything: bool = False) -> tuple[float, np.ndarray, np.ndarray]:
    """Train on labelled rows outside the held-out fifth (crc32 of doc_id as text, mod 5 = 0).

    Ids are taken in the order of a hash, at most `most`, each with one text (that of the smallest
    hash, where the id repeats) and its largest label. Their features are made where the texts are;
    one task trains on them in that order, until it holds MOST_FEATURES. Null labels are left out.
    """
    named = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("_label"))
    if not everything:
        named = named.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    chosen = named.groupBy("doc_id").agg(F.max("_label").alias("_label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("_text")).join(F.broadcast(chosen), "doc_id")
    picked = rows.groupBy("doc_id", "_label").agg(F.min(F.struct(F.xxhash64("_text").alias("h"), "_text")).alias("_one")).select("doc_id", "_label", F.col("_one._text").alias("_text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "_text"):
                found = [x.astype("<i4").tobytes() for x in per_row(part.column(2))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.binary())], names=["doc_id", "label", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels_, rows, held = [], [], [], 0
        for doc_id, label_, x in (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)):
            held += len(x) // 4
            if held > MOST_FEATURES:
                break
            ids.append(doc_id)
            labels_.append(label_)
            rows.append(np.frombuffer(x, "<i4").copy())
        if not ids:
            return
        order = sorted(range(len(ids)), key=lambda k: (ids[k], labels_[k], len(rows[k])))
        bias, live, w = train([rows[k] for k in order], np.array([labels_[k] for k in order]))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(live, -1), pa.int64()), pa.array(np.append(w, bias), pa.float64())], names=["feature", "weight"])

    sketched = common.arrow_map(picked, sketch, "doc_id long, label double, x binary")
    got = sketched.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").mapInArrow(learn, "feature long, weight double").toPandas()
    weights = got[got.feature >= 0].sort_values("feature")
    bias = float(got[got.feature < 0].weight.iloc[0]) if len(got) else NO_LABELS
    return bias, weights.feature.to_numpy(), weights.weight.to_numpy()


class Scorer:
    """Scores of whole texts under the sparse weights."""

    def __init__(self, bias: float, live: np.ndarray, weights: np.ndarray):
        self.bias = bias
        self.table = np.zeros(1 << BITS, np.float32)
        self.table[live] = weights

    def __call__(self, column: pa.Array) -> np.ndarray:
        row, feature = features(column)
        hit = self.table[feature] != 0
        key = common.distinct((row[hit] << BITS) | feature[hit])
        total = np.bincount(key >> BITS, weights=self.table[key & ((1 << BITS) - 1)], minlength=len(column))
        return 1.0 / (1.0 + np.exp(-np.clip(self.bias + total, -30, 30)))


def score(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; null or empty text gets the bias alone.

    Rows stand alone, so repeated rows and empty tables need no rule. A null doc_id is not held out.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*model)
        for batch in batches:
            for part in common.slices(batch, "_text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scorer(part.column(1)))], schema=schema)

    scored = common.arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text")), kernel, "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray], threshold: float = 0.5) -> DataFrame:
    """The rows of `docs`, all columns, whose score is below `threshold`; nothing is shuffled.

    Rows stand alone, so repeated rows and empty tables need no rule; empty or null text has the bias alone.
    """
    names = docs.columns
    kind = docs.schema

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*model)
        for batch in batches:
            for part in common.slices(batch, "text"):
                yield part.filter(pa.array(scorer(part.column(names.index("text"))) < threshold))

    return common.arrow_map(docs, kernel, kind)

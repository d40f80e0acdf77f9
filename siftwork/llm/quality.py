"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text, open to new words.

The top level counts pairs of words of all trusted rows, the level below it in how many contexts a
word continues; these tables grow with the corpus. Below them, in place of a uniform share for
words not seen, stands the spelling: n-grams of symbols over the distinct trusted words (Kneser-Ney
continuation counts), whose table the alphabet bounds (SYMBOLS^ORDER). A word that repeats the word
before it counts as the empty word, of one symbol. The first word of a row follows its last one, so
that each word is a context once. A repeated word is no context (all mass is handed down), or else
runs of one word, once seen, would be as likely as text.

p(w|v) = (c(v, w) - D(c)) / total(v) + hand(v) * low(w), with low(w) = share(w) + mass * spelled(w).

Counts are never gathered, but joined in shards. A group of documents (GROUP_BYTES of text) asks a
shard once for each distinct word or pair it holds: sorted keys as packed differences, about three
bytes each. The shard answers in the order asked, a byte or less for a pair. The group's texts are
read again, as numbers of its words, and take their sums from the answers, in whole units of
2^-20 bits, so that no order of adding changes a score. No (word, document) entry moves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm import common

ORDER = 4
SYMBOLS = 51
#: Symbols with a meaning of their own; letters follow from 0, classes of bytes from CONTINUED.
START, UPPER, DIGIT, SPACE, STOP, COMMA, JOIN, MARK, LEAD, CONTINUED = 26, 27, 28, 29, 30, 31, 32, 33, 34, 35
#: Share of trusted text of a language that lies under its threshold.
QUANTILE = 0.999
#: Accuracy of the quantiles: errors of rank below 1 / ACCURACY.
ACCURACY = 100_000
#: One trusted row in so many is kept from training and sets the thresholds.
FOLDS = 5
#: A group of documents ends at so many bytes of text, or rows.
GROUP_BYTES, GROUP_ROWS = 16 << 20, 1 << 16
#: Pairs that a counting task holds before it hands on, and bytes of text that a kernel looks at in one step.
HELD, STEP_BYTES = 1 << 18, 1 << 19
#: Bytes of text for which there is one shard of the counts: the first while there are fewer than SHARDS_NARROW shards,
#: then more, up to the second; and the fewest and most shards.
SHARD_BYTES, SHARD_BYTES_WIDE, SHARDS_LEAST, SHARDS_NARROW, SHARDS_MOST = 4 << 20, 64 << 20, 16, 256, 1 << 16
#: Words as keys: 48 bits, so that a word shares its key with one of 10^8 others with a chance of 4e-7.
KEY = np.uint64((1 << 48) - 1)
#: Units of a bit in which a document's sum is added.
UNIT = float(1 << 20)
#: Key of a word that repeats the one before it.
REPEATED = np.uint64(0x5EED)
_INSIDE = np.ones(256, bool)
_INSIDE[[9, 10, 11, 12, 13, 32]] = False
_SAME = np.arange(256, dtype=np.uint8)


def _classes() -> np.ndarray:
    out = np.full(256, MARK, np.uint8)
    out[97:123] = np.arange(26)
    out[65:91] = UPPER
    out[48:58] = DIGIT
    out[[9, 10, 11, 12, 13, 32]] = SPACE
    out[ord(".")] = STOP
    out[ord(",")] = COMMA
    out[[ord("-"), ord("'")]] = JOIN
    out[0x80:0xC0] = CONTINUED + (np.arange(64) & 15)
    out[0xC0:] = LEAD
    return out


def symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all rows end to end, each row after ORDER - 1 START symbols, and n + 1 offsets."""
    data, offsets = common.buffer_of(column)
    size = np.diff(offsets)
    ends = np.concatenate([[0], np.cumsum(size + ORDER - 1)])
    out = np.full(int(ends[-1]), START, np.uint8)
    out[np.arange(len(data)) + np.repeat((ORDER - 1) * (np.arange(len(size)) + 1), size)] = _classes()[data]
    return out, ends


def grams(codes: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The n-gram that ends at each place from order - 1 on, as a number to the base SYMBOLS."""
    out = codes[: len(codes) - order + 1].astype(np.int32)
    for k in range(1, order):
        out = out * SYMBOLS + codes[k : len(codes) - order + 1 + k]
    return out


def count(words: DataFrame) -> DataFrame:
    """(gram, n): counts of n-grams of ORDER over all texts, summed in shards of the n-gram."""
    schema = pa.schema([("gram", pa.int32()), ("n", pa.int64())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**ORDER, np.int32)  # of one input split, far below 2^31
        for batch in batches:
            for part in common.slices(batch, "_text", STEP_BYTES):
                codes, ends = symbols(part.column(0))
                if len(codes) < ORDER:
                    continue
                found = grams(codes)
                last = codes[ORDER - 1 :]
                found = found[last != START]  # n-grams that reach over the end of a row
                values, n = np.unique(found, return_counts=True)
                total[values] += n
        live = np.flatnonzero(total)
        for low in range(0, len(live), 50_000):
            some = live[low : low + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some].astype(np.int64))], schema=schema)

    return common.arrow_map(words.select(F.col("text").alias("_text")), kernel, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of n-grams seen 1 to 4 times."""
    return _discounts_of(*counts.agg(*[F.count(F.when(F.col("n") == k, 1)) for k in (1, 2, 3, 4)]).first())


def _level(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of one order: (gram, context, suffix, share) after discounting, and (context, mass) to hand down."""
    d1, d2, d3 = _discounts(counts)
    n = F.col("n")
    discount = F.when(n == 1, d1).when(n == 2, d2).otherwise(d3)
    context = F.floor(F.col("gram") / SYMBOLS).cast("int")
    rows = counts.withColumn("context", context).withColumn("_cut", F.least(discount, n.cast("double")))
    sums = rows.groupBy("context").agg(F.sum("n").alias("_total"), F.sum("_cut").alias("_freed"))
    shares = rows.join(sums, "context").select("gram", "context", ((n - F.col("_cut")) / F.col("_total")).alias("share"))
    return shares, sums.select("context", (F.col("_freed") / F.col("_total")).alias("mass"))


class Model:
    """log2 of the interpolated probability of every n-gram, seen or not: SYMBOLS^ORDER floats (29 MB)."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        self.levels = levels  # from order 1 up: grams, shares, contexts, masses

    def table(self) -> np.ndarray:
        """One array of the final size is alive at a time, in single precision."""
        below = np.full(1, 1.0 / SYMBOLS, np.float32)
        for k, (gram, share, context, mass) in enumerate(self.levels):
            hand = np.ones(SYMBOLS**k, np.float32)
            hand[context] = mass
            if k:  # the suffix of (c0 c1 .. ck-1, s) is (c1 .. ck-1, s)
                table = (hand.reshape(SYMBOLS, -1, 1) * below.reshape(1, -1, SYMBOLS)).reshape(-1)
            else:
                table = np.repeat(hand * below, SYMBOLS)
            table[gram] += share.astype(np.float32)
            below = table
        np.maximum(below, np.float32(1e-12), out=below)
        return np.log2(below, out=below)


def spelling(words: DataFrame) -> Model:
    """Modified Kneser-Ney from n-gram counts of all `text`s: distinct words, each with a blank after it.

    Lower orders count in how many contexts an n-gram continues. Counting, discounting and the
    joins of counts with their contexts are DataFrame operations sharded by n-gram; what comes to
    the driver is the finished shares, at most SYMBOLS^ORDER of them. No words: uniform.
    """
    scratch = common.Scratch(words.sparkSession)
    counts = scratch.keep(count(words))
    levels = []
    for order in range(ORDER, 0, -1):
        shares, masses = _level(counts)
        s = shares.select("gram", "share").toPandas()
        m = masses.toPandas()
        levels.append((s.gram.to_numpy(np.int64), s.share.to_numpy(float), m.context.to_numpy(np.int64), m["mass"].to_numpy(float)))
        if order > 1:
            counts = scratch.keep(counts.groupBy((F.col("gram") % SYMBOLS ** (order - 1)).cast("int").alias("gram")).agg(F.count("*").alias("n")))
    scratch.release()
    return Model(levels[::-1])


def words_in(column: pa.Array) -> tuple[np.ndarray, ...]:
    """Bytes of the rows, and of every word: key, row, first byte and length (repeated words: 0)."""
    data, offsets = common.buffer_of(column)
    start, end, row = common.spans_of(data, offsets, _INSIDE)
    (key,) = common.hash_spans(data, start, end, _SAME)
    again = np.zeros(len(key), bool)
    again[1:] = (key[1:] == key[:-1]) & (row[1:] == row[:-1])
    return data, np.where(again, REPEATED, key & KEY), row, start, np.where(again, 0, end - start)


def before(key: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Of every word: the key of the word before it, round the row."""
    prev = np.empty_like(key)
    if len(key):
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        prev[1:] = key[:-1]
        prev[first] = key[np.append(first[1:], len(key)) - 1]
    return prev


def shards_for(size: int) -> int:
    """Shards grow in number, then in size, then in number again: every group asks every shard, so that fewer are better."""
    return int(min(max(min(size // SHARD_BYTES, SHARDS_NARROW), size // SHARD_BYTES_WIDE, SHARDS_LEAST), SHARDS_MOST))


def word_places(key: np.ndarray, shards: int) -> np.ndarray:
    """48-bit keys to shard << 48 | key."""
    return (((key >> np.uint64(24)) * np.uint64(shards)) >> np.uint64(24)) << np.uint64(48) | key


def pair_places(prev: np.ndarray, key: np.ndarray, shards: int, hot: np.ndarray) -> np.ndarray:
    """Pairs to shard << 40 | 40 bits of the pair. Pairs of a word lie in one shard; those of a `hot` one in all."""
    pair = common.mix64(common.mix64(prev + np.uint64(1)) + key)
    by = common.mix64(prev)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, prev), len(hot) - 1)
        by = np.where(hot[at] == prev, pair, by)
    return (((by >> np.uint64(40)) * np.uint64(shards)) >> np.uint64(24)) << np.uint64(40) | (pair & np.uint64((1 << 40) - 1))


_CODEC = pa.Codec("zstd", compression_level=1)


def pack(values: np.ndarray, sort: bool = False) -> bytes:
    """Integers from 0 on, or the differences of rising ones, as compressed planes of bytes."""
    values = values.astype("<u8")
    if sort:
        values = np.diff(values, prepend=np.uint64(0))
    planes = (int(values.max(initial=0)).bit_length() + 7) // 8
    raw = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :planes].T)
    return len(values).to_bytes(4, "little") + bytes([planes]) + (_CODEC.compress(raw, asbytes=True) if raw.size else b"")


def unpack(blob: bytes, sort: bool = False) -> np.ndarray:
    n, planes = int.from_bytes(blob[:4], "little"), blob[4]
    out = np.zeros((n, 8), np.uint8)
    if n and planes:
        out[:, :planes] = np.frombuffer(_CODEC.decompress(blob[5:], n * planes), np.uint8).reshape(planes, n).T
    values = out.view("<u8").reshape(n)
    return np.cumsum(values, dtype=np.uint64) if sort else values


def spelled(data: np.ndarray, start: np.ndarray, length: np.ndarray, table: np.ndarray) -> np.ndarray:
    """log2 of the probability that the spelling model gives to each word and the blank after it."""
    if not len(start):
        return np.zeros(0)
    ends = np.concatenate([[0], np.cumsum(length + ORDER)])
    codes = np.full(int(ends[-1]), START, np.uint8)
    inner = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    codes[np.repeat(ends[:-1] + ORDER - 1, length) + inner] = _classes()[data[np.repeat(start, length) + inner]]
    codes[ends[1:] - 1] = SPACE
    logs = np.zeros(len(codes))
    logs[ORDER - 1 :] = table[grams(codes)]
    logs[codes == START] = 0
    return np.add.reduceat(logs, ends[:-1])


#: Columns of the counts of a word: contexts it continues; occurrences as context; pairs it starts that were seen once, twice, more often.
COUNTS = ("cont", "total", "one", "two", "more")


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): counts of the words of all rows; each slice of a text counts its own first."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "_text", STEP_BYTES):
                data, key, _, start, length = words_in(part.column(0))
                key, first, n = np.unique(key, return_index=True, return_counts=True)
                whole = data.tobytes()
                words = [whole[i : i + k] for i, k in zip(start[first].tolist(), length[first].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(n)], schema=schema)

    found = common.arrow_map(docs.select(F.col("text").alias("_text")), kernel, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def keyed(words: DataFrame) -> DataFrame:
    """(key, n) of (word, n)."""
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.full(batch.num_rows, REPEATED)
            _, found, row, _, _ = words_in(batch.column("word"))
            key[row] = found  # a row is one word, or empty
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("n")], schema=schema)

    return common.arrow_map(words, kernel, "key long, n long")


def pair_counts(docs: DataFrame, shards: int, hot: np.ndarray) -> DataFrame:
    """Counted pairs of all rows: (shard, blob) with the pairs of a shard and their counts, the
    words' counts (key, then COUNTS; several rows may add up for a word), and (n1 .. n4), how many
    pairs of the shard were seen so often. A repeated word is no context: such pairs count for the word alone.
    """
    found = pa.schema([("shard", pa.int32()), ("blob", pa.binary())])
    made = pa.schema([("shard", pa.int32()), ("blob", pa.binary()), *[(c, pa.int64()) for c in ("key", *COUNTS, "n1", "n2", "n3", "n4")]])

    def emit(got: list[tuple]) -> Iterator[pa.RecordBatch]:
        prev, key = (np.concatenate(x) for x in zip(*got, strict=True))
        place = pair_places(prev, key, shards, hot)
        _, first, n = np.unique(place, return_index=True, return_counts=True)
        shard = (place[first] >> np.uint64(40)).astype(np.int64)
        order = np.lexsort((key[first], prev[first], shard))
        shard, prev, key, n = shard[order], prev[first][order], key[first][order], n[order]
        ends = np.searchsorted(shard, np.arange(shards + 1))
        live = np.flatnonzero(np.diff(ends))
        for some in np.array_split(live, max(1, len(live) // 64)):
            blobs = [_bundle(prev[ends[k] : ends[k + 1]], key[ends[k] : ends[k + 1]], n[ends[k] : ends[k + 1]]) for k in some.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(blobs, pa.binary())], schema=found)

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, held = [], 0
        for batch in batches:
            for part in common.slices(batch, "_text", STEP_BYTES):
                _, key, row, _, _ = words_in(part.column(0))
                got.append((before(key, row), key))
                held += len(key)
                if held > HELD:
                    yield from emit(got)
                    got, held = [], 0
        if held:
            yield from emit(got)

    def finish(shard: int, prev: np.ndarray, key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        real = prev != REPEATED
        place = pair_places(prev[real], key[real], shards, hot)
        order = np.argsort(place)
        real_n = n[real]
        few = [int((real_n == k).sum()) for k in (1, 2, 3, 4)]
        blob = _bundle(place[order] & np.uint64((1 << 40) - 1), None, real_n[order])
        words, at = np.unique(np.concatenate([key, prev[real]]), return_inverse=True)
        of_key, of_prev = at[: len(key)], at[len(key) :]
        add = lambda where, what=None: np.bincount(where, weights=what, minlength=len(words)).astype(np.int64)
        columns = [add(of_key), add(of_prev, real_n), add(of_prev[real_n == 1]), add(of_prev[real_n == 2]), add(of_prev[real_n > 2])]
        first = [pa.array([shard], pa.int32()), pa.array([blob], pa.binary()), *[pa.nulls(1, pa.int64()) for _ in range(6)], *[pa.array([x], pa.int64()) for x in few]]
        yield pa.RecordBatch.from_arrays(first, schema=made)
        for low in range(0, len(words), 50_000):
            some = slice(low, low + 50_000)
            size = len(words[some])
            yield pa.RecordBatch.from_arrays([pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary()), pa.array(words[some].view(np.int64)), *[pa.array(c[some]) for c in columns], *[pa.nulls(size, pa.int64()) for _ in range(4)]], schema=made)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, got = None, 0, []
        for batch in batches:
            for shard, blob in zip(batch.column("shard").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if shard != own:
                    if got:
                        yield from finish(own, *_merged(got))
                    own, held, got = shard, 0, []
                got.append(_unbundle(blob, True))
                held += len(got[-1][0])
                if held > HELD:  # what is held shrinks to its distinct pairs
                    got = [_merged(got)]
                    held = 0
        if got:
            yield from finish(own, *_merged(got))

    sent = common.arrow_map(docs.select(F.col("text").alias("_text")), count_pairs, "shard int, blob binary")
    sent = sent.repartition("shard").sortWithinPartitions("shard")
    return common.arrow_map(sent, merge, "shard int, blob binary, " + ", ".join(f"{c} long" for c in ("key", *COUNTS, "n1", "n2", "n3", "n4")))


def _bundle(sorted_: np.ndarray, key: np.ndarray | None, n: np.ndarray) -> bytes:
    """Sorted numbers, with keys or without, and counts, in one blob."""
    parts = [pack(sorted_, True), *([] if key is None else [pack(key)]), pack(n)]
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def _unbundle(blob: bytes, keys: bool) -> tuple[np.ndarray, ...]:
    out, at = [], 0
    for k in range(3 if keys else 2):
        size = int.from_bytes(blob[at : at + 4], "little")
        out.append(unpack(blob[at + 4 : at + 4 + size], k == 0))
        at += 4 + size
    return tuple(out)


def _merged(got: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of equal pairs added; sorted by the first word, then by the second."""
    prev, key, n = (np.concatenate(x) for x in zip(*got, strict=True))
    order = np.lexsort((key, prev))
    prev, key, n = prev[order], key[order], n[order].astype(np.int64)
    new = np.flatnonzero(np.append(True, (prev[1:] != prev[:-1]) | (key[1:] != key[:-1])))
    return prev[new], key[new], np.add.reduceat(n, new)


class Words:
    """The trained model.

    `counts` (key, then COUNTS) of the words, `pairs` (shard, blob) of counted pairs or None for
    order 1, the discounts of both levels, the sum of all `cont`, the mass left to the spelling and its model.
    """

    def __init__(self, counts: DataFrame, pairs: DataFrame | None, word_cut: tuple, pair_cut: tuple, of_all: int, mass: float, model: Model, shards: int, hot: np.ndarray):
        self.counts, self.pairs, self.word_cut, self.pair_cut, self.of_all, self.mass, self.model, self.shards, self.hot = counts, pairs, word_cut, pair_cut, of_all, mass, model, shards, hot

    @property
    def shares(self) -> DataFrame:
        """(key, share) of the words: what the discounts leave of their counts."""
        d1, d2, d3 = self.word_cut
        n = F.col("cont")
        return self.counts.where("cont > 0").select("key", ((n - F.least(F.when(n == 1, d1).when(n == 2, d2).otherwise(d3), n.cast("double"))) / float(self.of_all)).alias("share"))

    def low(self, cont: np.ndarray, spelled_: np.ndarray) -> np.ndarray:
        return (cont - _discount(cont, self.word_cut)) / max(self.of_all, 1) + self.mass * np.exp2(spelled_)


def _discount(n: np.ndarray, cut: tuple) -> np.ndarray:
    return np.minimum(np.array([0.0, *cut])[np.minimum(n, 3).astype(np.int64)], n)


def _discounts_of(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of things seen 1 to 4 times."""
    n1, n2, n3, n4 = (max(float(x or 0), 1.0) for x in (n1, n2, n3, n4))
    y = n1 / (n1 + 2 * n2)
    bound = lambda d, most: min(max(d, 0.05), most)
    return bound(1 - 2 * y * n2 / n1, 0.95), bound(2 - 3 * y * n3 / n2, 1.95), bound(3 - 4 * y * n4 / n3, 2.95)


def train(trusted: DataFrame, order: int = 1, shards: int = SHARDS_LEAST) -> Words:
    """All levels, from all words of all rows of `trusted`. No words: all mass goes to a uniform spelling.

    Order 1 counts words; order 2 counts pairs, and of words the contexts. Words that make more than
    a quarter of a shard (so at most 4 * shards of them) are hot: their pairs are dealt to all shards.
    """
    scratch = common.Scratch(trusted.sparkSession)
    words = scratch.keep(word_counts(trusted))
    model = spelling(words.select(F.concat("word", F.lit(" ")).alias("text")))
    hot, pairs, pair_cut = np.zeros(0, np.uint64), None, (0.0, 0.0, 0.0)
    if order > 1:
        total = words.agg(F.sum("n")).first()[0] or 0
        found = keyed(words.where(F.col("n") > total / (4.0 * shards))).toPandas()
        hot = np.sort(found.key.to_numpy(np.int64).view(np.uint64))
        made = scratch.keep(pair_counts(trusted, shards, hot))
        pairs = made.where("blob is not null").select("shard", "blob")
        pair_cut = _discounts_of(*made.agg(*[F.sum(f"n{k}") for k in (1, 2, 3, 4)]).first())
        counts = made.where("key is not null").groupBy("key").agg(*[F.sum(c).alias(c) for c in COUNTS])
    else:
        counts = keyed(words).select("key", F.col("n").alias("cont"), *[F.lit(0).cast("long").alias(c) for c in COUNTS[1:]])
    counts = scratch.keep(counts)
    scratch.free(words)
    n = F.col("cont")
    facts = counts.agg(F.sum(n), *[F.count(F.when(n == k, 1)) for k in (1, 2, 3, 4)], F.count(F.when(n > 2, 1))).first()
    word_cut = _discounts_of(*facts[1:5])
    of_all = int(facts[0] or 0)
    mass = (word_cut[0] * facts[1] + word_cut[1] * facts[2] + word_cut[2] * facts[5]) / of_all if of_all else 1.0
    return Words(scratch.tie(counts), pairs, word_cut, pair_cut, of_all, mass, model, shards, hot)


_META = "meta array<struct<row_key: long, doc_id: long, lang: string, n_symbols: long, words: long>>"
_META_TYPE = pa.list_(pa.struct([("row_key", pa.int64()), ("doc_id", pa.int64()), ("lang", pa.string()), ("n_symbols", pa.int64()), ("words", pa.int64())]))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, bool]]:
    """(group, slice of rows, whether it is the group's last); the same for each reading of the same rows."""
    grp, held, size, last = None, 0, 0, None
    for batch in batches:
        if grp is None and batch.num_rows:
            grp = batch.column("_part")[0].as_py() << 24
        for part in common.slices(batch, "_text", STEP_BYTES):
            if last is not None:
                full = size > GROUP_BYTES or held > GROUP_ROWS
                yield grp, last, full
                if full:
                    grp, held, size = grp + 1, 0, 0
            last = part
            held, size = held + part.num_rows, size + part.nbytes
    if last is not None:
        yield grp, last, True


def _by_shard(grp: int, place: np.ndarray, bits: int, shards: int) -> Iterator[pa.RecordBatch]:
    """Sorted places of a group as one packed question to each shard."""
    ends = np.searchsorted(place, np.arange(shards + 1, dtype=np.uint64) << np.uint64(bits))
    live = np.flatnonzero(np.diff(ends))
    low = np.uint64((1 << bits) - 1)
    for some in np.array_split(live, max(1, len(live) // 256)):
        blobs = [pack(place[ends[k] : ends[k + 1]] & low, True) for k in some.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), grp)), pa.array(blobs, pa.binary())], names=["shard", "grp", "blob"])


def _asked(rows: DataFrame, words: Words, pairs: bool) -> DataFrame:
    """(shard, grp, blob): the distinct words, or pairs, of each group of rows, packed by shard."""
    shards, hot = words.shards, words.hot

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, held = [], 0
        for grp, part, ends in _groups(batches):
            _, key, row, _, _ = words_in(part.column("_text"))
            if pairs:
                prev = before(key, row)
                real = prev != REPEATED
                found = pair_places(prev[real], key[real], shards, hot)
            else:
                found = word_places(key, shards)
            got.append(common.distinct(found))
            held += len(got[-1])
            if ends or held > HELD:
                got, held = [common.distinct(np.concatenate(got))], 0
            if ends:
                yield from _by_shard(grp, got[0], 40 if pairs else 48, shards)
                got = []

    return common.arrow_map(rows, kernel, "shard int, grp long, blob binary")


def _answered(asked: DataFrame, words: Words, pairs: bool) -> DataFrame:
    """(grp, shard, kind, blobs): the counts of what was asked, in the order asked; 0 where not seen.

    A task holds the counts of one shard (SHARD_BYTES_WIDE of text at most, while there are less than SHARDS_MOST);
    questions stream past them.
    """
    count = 1 if pairs else len(COUNTS)
    schema = pa.schema([("grp", pa.int64()), ("shard", pa.int32()), ("kind", pa.int32()), ("blobs", pa.list_(pa.binary())), ("meta", _META_TYPE)])
    none = [F.lit(None).cast("long").alias(c) for c in ("key", *COUNTS)]
    if pairs:
        model = words.pairs.select("shard", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("grp"), "blob", *none)
    else:
        shard = F.shiftright(F.shiftright("key", 24) * words.shards, 24).cast("int")
        model = words.counts.select(shard.alias("shard"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("grp"), F.lit(None).cast("binary").alias("blob"), "key", *COUNTS)

    def arrays(got: list) -> tuple[np.ndarray, list[np.ndarray]]:
        if not got:
            return np.zeros(0, np.uint64), [np.zeros(0, np.uint64)] * count
        key, *values = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.argsort(key)
        return key[order], [v[order] for v in values]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, got, ready = None, [], None
        for batch in batches:
            shard, kind = (batch.column(c).to_numpy() for c in ("shard", "kind"))
            out = []
            for low, high in _runs(shard, kind):
                if shard[low] != own:
                    own, got, ready = shard[low], [], None
                if kind[low] == 0:
                    if pairs:
                        got += [_unbundle(b, False) for b in batch.column("blob").slice(low, high - low).to_pylist()]
                    else:
                        got.append(tuple(batch.column(c).slice(low, high - low).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("key", *COUNTS)))
                    continue
                if ready is None:
                    ready, got = arrays(got), []
                key, values = ready
                for grp, blob in zip(batch.column("grp").slice(low, high - low).to_pylist(), batch.column("blob").slice(low, high - low).to_pylist(), strict=True):
                    ask = unpack(blob, True)
                    at = np.minimum(np.searchsorted(key, ask), max(len(key) - 1, 0))
                    hit = key[at] == ask if len(key) else np.zeros(len(ask), bool)
                    out.append((grp, int(own), int(pairs), [pack(np.where(hit, v[at], 0) if len(key) else np.zeros(len(ask))) for v in values], None))
            if out:
                yield common.batch_of(schema, zip(*out, strict=True))

    both = model.unionByName(asked.select("shard", F.lit(1).alias("kind"), "grp", "blob", *none))
    both = both.repartition("shard").sortWithinPartitions("shard", "kind")
    return common.arrow_map(both, kernel, "grp long, shard int, kind int, blobs array<binary>, " + _META)


def _runs(*columns: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, end) of the runs of rows with equal values."""
    n = len(columns[0])
    if n:
        cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        yield from zip([0, *cut.tolist()], [*cut.tolist(), n], strict=True)


def _numbered(rows: DataFrame, model: Model) -> DataFrame:
    """The groups once more, as rows of _answered(): kind 2, the places of the distinct words and the
    bits of their spelling (in 1 / 1024); kind 3, slices of the words' numbers with `meta` of the documents.
    """
    schema = pa.schema([("grp", pa.int64()), ("shard", pa.int32()), ("kind", pa.int32()), ("blobs", pa.list_(pa.binary())), ("meta", _META_TYPE)])

    def row(grp: int, at: int, kind: int, blobs: list[bytes], meta: pa.Array | None) -> pa.RecordBatch:
        meta = pa.nulls(1, _META_TYPE) if meta is None else pa.ListArray.from_arrays(pa.array([0, len(meta)], pa.int32()), meta)
        return pa.RecordBatch.from_arrays([pa.array([grp]), pa.array([at], pa.int32()), pa.array([kind], pa.int32()), pa.array([blobs], pa.list_(pa.binary())), meta], schema=schema)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        known, bits, got = np.zeros(0, np.uint64), np.zeros(0, np.int64), []
        for grp, part, ends in _groups(batches):
            data, key, where, start, length = words_in(part.column("_text"))
            distinct, first, inverse = np.unique(key, return_index=True, return_inverse=True)
            at = np.minimum(np.searchsorted(known, distinct), max(len(known) - 1, 0))
            new = known[at] != distinct if len(known) else np.ones(len(distinct), bool)
            fresh = first[new]
            known = np.concatenate([known, distinct[new]])
            bits = np.concatenate([bits, np.rint(-1024 * spelled(data, start[fresh], length[fresh], table)).astype(np.int64)])
            order = np.argsort(known, kind="stable")
            known, bits = known[order], bits[order]
            n = part.num_rows
            meta = [part.column("row_key"), part.column("doc_id"), part.column("lang"), pa.array(np.bincount(where, weights=length + 1, minlength=n).astype(np.int64)), pa.array(np.bincount(where, minlength=n).astype(np.int64))]
            got.append((distinct, inverse.astype(np.uint32), pa.StructArray.from_arrays(meta, fields=list(_META_TYPE.value_type))))
            if ends:
                yield row(grp, 0, 2, [pack(known, True), pack(bits)], None)
                for k, (own, inverse, meta) in enumerate(got):
                    yield row(grp, k, 3, [pack(np.searchsorted(known, own)[inverse])], meta)
                known, bits, got = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

    return common.arrow_map(rows, kernel, "grp long, shard int, kind int, blobs array<binary>, " + _META)


def _finisher(words: Words):
    """One group: answers to its documents. All of it is bounded by the group's text."""
    shards, hot, order = words.shards, words.hot, 1 if words.pairs is None else 2
    fixed = Words(None, None, words.word_cut, words.pair_cut, words.of_all, words.mass, None, shards, hot)
    schema = pa.schema([("row_key", pa.int64()), ("doc_id", pa.int64()), ("lang", pa.string()), ("n_symbols", pa.int64()), ("perplexity", pa.float64())])

    def finish(table: pa.Table) -> pa.Table:
        kind, shard = table.column("kind").to_numpy(), table.column("shard").to_numpy()
        blobs, meta = table.column("blobs").combine_chunks(), table.column("meta").combine_chunks()
        rows_of = lambda k: [i for i in np.argsort(shard, kind="stable").tolist() if kind[i] == k]
        key, spell = (unpack(b, s) for b, s in zip(blobs[rows_of(2)[0]].as_py(), (True, False), strict=True))
        got = [[unpack(b) for b in blobs[i].as_py()] for i in rows_of(0)]
        cont, total, one, two, more = (np.concatenate(x).astype(np.int64) for x in zip(*got, strict=True)) if got else [np.zeros(0, np.int64)] * 5
        if len(cont) != len(key):
            raise RuntimeError("rows changed between two readings of the documents")
        low = fixed.low(cont, spell.astype(float) / -1024)
        d1, d2, d3 = fixed.pair_cut
        seen = np.maximum(total, 1)
        hand = np.where((total > 0) & (key != REPEATED), (d1 * one + d2 * two + d3 * more) / seen, 1.0) if order > 1 else np.ones(len(key))
        last = rows_of(3)
        number = np.concatenate([unpack(blobs[i].as_py()[0]).astype(np.uint32) for i in last])
        own = pa.concat_arrays([meta[i].values for i in last])
        del got
        size = own.field("words").to_numpy()
        start = np.cumsum(size) - size
        prev = np.empty_like(number)
        if len(number):
            prev[1:] = number[:-1]
            full = size > 0
            prev[start[full]] = number[(start + size - 1)[full]]
        # The words are taken in steps, twice: only their numbers and their sums are held for the whole group.
        steps = [slice(begin, begin + HELD) for begin in range(0, len(number), HELD)]

        def pairs(step: slice) -> tuple[np.ndarray, np.ndarray]:
            real = np.flatnonzero(key[prev[step]] != REPEATED)
            return real, pair_places(key[prev[step][real]], key[number[step][real]], shards, hot)

        if order > 1:
            place, n = np.empty(len(number), np.uint64), 0
            for step in steps:
                found = common.distinct(pairs(step)[1])
                place[n : n + len(found)] = found
                n += len(found)
            place = place[:n]
            place.sort()
            place = place[np.append(True, place[1:] != place[:-1])[:n]]
            found = (unpack(blobs[i].as_py()[0]) for i in rows_of(1))
            count = np.concatenate([np.zeros(0, np.int32), *[x.astype(np.int32 if x.max(initial=0) < 1 << 31 else np.int64) for x in found]])
            if len(count) != len(place):
                raise RuntimeError("rows changed between two readings of the documents")
        bounds, sums, carry = np.append(0, start + size), np.zeros(len(size) + 1, np.int64), 0
        for step in steps:
            p = hand[prev[step]] * low[number[step]]
            if order > 1:
                real, asked = pairs(step)
                asked, at = np.unique(asked, return_inverse=True)
                n = count[np.searchsorted(place, asked)][at]
                hit = n > 0
                real, n = real[hit], n[hit]
                p[real] += (n - _discount(n, fixed.pair_cut)) / seen[prev[step][real]]
            total_bits = carry + np.cumsum(np.rint(np.log2(np.maximum(p, 1e-300)) * UNIT).astype(np.int64))
            here = slice(*np.searchsorted(bounds, [step.start, step.start + len(p)], side="right"))
            sums[here], carry = total_bits[bounds[here] - step.start - 1], total_bits[-1]
        n_symbols = own.field("n_symbols").to_numpy()
        value = np.exp2((sums[:-1] - sums[1:]) / UNIT / np.maximum(n_symbols, 1))
        common.give_back()
        return pa.Table.from_arrays([own.field("row_key"), own.field("doc_id"), own.field("lang"), own.field("n_symbols"), pa.array(value)], schema=schema)

    return finish


def row_key() -> F.Column:
    return F.xxhash64("doc_id", "lang", "text")


def held_out() -> F.Column:
    return F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(FOLDS)) == 0


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def score(docs: DataFrame, words: Words, last: bool = False) -> DataFrame:
    """(row_key, doc_id, lang, n_symbols, perplexity) of every row; null text counts as empty, null lang as ''.

    With `last`, the model's tables are let go of as soon as they have answered.

    No symbols: perplexity 1. The rows are read once for each question and once for the sums, and
    must come in the same order each time: what is not a plain read of files is written first.
    """
    scratch = common.Scratch(docs.sparkSession)
    rows = docs.select(row_key().alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("text").alias("_text"))
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        rows = scratch.keep(rows)
    rows = rows.withColumn("_part", F.spark_partition_id())  # of the read itself, also under a union
    answers = scratch.keep(_answered(_asked(rows, words, False), words, False))
    if words.pairs is not None:
        answers = answers.union(scratch.keep(_answered(_asked(rows, words, True), words, True)))
    if last:
        common.release(words.counts)
    every = answers.union(_numbered(rows, words.model))
    return scratch.tie(every.groupBy("grp").applyInArrow(_finisher(words), "row_key long, doc_id long, lang string, n_symbols long, perplexity double"))


def good_ids(labels: DataFrame) -> DataFrame:
    """Distinct ids that the labels call good."""
    return labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()


def trusted_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows that the labels call good; the ids are broadcast only if they are few."""
    return common.small_join(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text"), good_ids(labels), "doc_id", "left_semi")


def thresholds(scored: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(lang, threshold) from scores of held-out trusted rows, mergeable sketches, one per language."""
    return scored.where("n_symbols > 0").groupBy("lang").agg(F.percentile_approx("perplexity", quantile, ACCURACY).alias("threshold"))


def _judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scratch = common.Scratch(docs.sparkSession)
    words = train(trusted_rows(docs, labels).where(~held_out()), order=2, shards=shards_for(text_bytes(docs)))
    found = score(docs, words, last=True)
    scored = scratch.keep(found)
    common.release(found)
    held = common.small_join(scored, good_ids(labels).where(held_out()), "doc_id", "left_semi")
    rest = held.where("n_symbols > 0").agg(F.percentile_approx("perplexity", QUANTILE, ACCURACY)).first()[0]
    limits = thresholds(held)
    out = scored.join(F.broadcast(limits) if limits.limit(10_001).count() <= 10_000 else limits, "lang", "left")
    out = out.withColumn("threshold", F.coalesce("threshold", F.lit(rest).cast("double")))
    kept = (F.col("n_symbols") > 0) & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return scratch.tie(out.withColumn("kept", kept))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, threshold and kept of every row.

    Kept: perplexity at most the threshold of the row's language. Empty texts are not kept. A
    language without held-out trusted text takes the overall threshold; without any at all, every
    row with text is kept. Repeated rows get one result each; null ids stay null.
    """
    judged = _judged(docs, labels)
    return judged._siftwork_scratch.tie(judged.select("doc_id", "lang", "n_symbols", "perplexity", "threshold", "kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that classify() keeps; keys of the rejected go to the texts."""
    judged = _judged(docs, labels)
    name = "_row_key"
    while name.lower() in (c.lower() for c in docs.columns):  # columns of the rows' own stay as they are
        name += "_"
    bad = judged.where("not kept").select(F.col("row_key").alias(name)).distinct()
    out = common.small_join(docs.withColumn(name, row_key()), bad, name, "left_anti").select(*docs.columns)
    return judged._siftwork_scratch.tie(out)

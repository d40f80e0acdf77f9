"""Order-preserving packing of documents into windows of tokens.

Cuts may fall between documents (free), between sentences (a small penalty) or, in long sentences,
at any of a grid of places (a larger one). best[j] = penalty[j] + W - p[j] + min(best[i] + p[i])
over the cuts i with p[j] - p[i] <= W: a sliding-window minimum, kept in a monotone queue.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm import common

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long"
WINDOW = 2048
END = 1
#: Penalties in tokens of padding: a cut between sentences, and one inside a sentence.
SENTENCE_CUT, HARD_CUT = 1.0, 4.0
#: Where no sentence ends for FAR tokens, every GRID-th place may be cut.
FAR, GRID = 48, 16
#: Tokens that one run of the dynamic programme covers.
BLOCK = 1 << 19
#: Bytes up to which the first text of a slice is also encoded by the tokenizers library.
CHECKED_BYTES = 1 << 16


class Encoder:
    """The byte-level BPE vocabulary: ids by tiktoken, held against tokenizers as it goes."""

    def __init__(self, json_path: str, ranks_path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.slow = Tokenizer.from_file(json_path)
        self.added = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        one = [self.fast.decode_single_token_bytes(i) for i in range(self.fast.n_vocab)]
        self.stops = np.zeros(1 << 17, bool)  # ids after which a sentence may end
        self.stops[[i for i, b in enumerate(one) if b.rstrip(b"\"')]\n").endswith((b".", b"!", b"?")) or b"\n" in b]] = True

    def plain(self, text: str) -> list[int]:
        """tokenizers finds its added tokens in a text, too; such texts are its own to encode."""
        if any(t in text for t in self.added):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def ids(self, text: str) -> np.ndarray:
        return np.append(np.asarray(self.plain(text), np.uint32), np.uint32(END))

    def check(self, text: str) -> None:
        if self.slow.encode(text, add_special_tokens=False).ids != self.plain(text):
            raise ValueError("tiktoken and tokenizers give other ids for a text")


@functools.lru_cache(2)
def encoder(json_path: str, ranks_path: str) -> Encoder:
    return Encoder(json_path, ranks_path)


def cuts(ids: np.ndarray, ends: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window may end, and the penalty of each; ends: of the documents."""
    place = common.distinct(np.concatenate([np.flatnonzero(stops[ids]) + 1, ends]))
    gap = np.diff(place, prepend=0)
    wide = np.flatnonzero(gap > FAR)
    grid = [np.arange(place[k] - gap[k] + GRID, place[k], GRID) for k in wide.tolist()]
    hard = np.concatenate(grid) if grid else np.zeros(0, np.int64)
    penalty = np.where(np.isin(place, ends), 0.0, SENTENCE_CUT)
    every = np.concatenate([place, hard])
    order = np.argsort(every, kind="stable")
    return every[order], np.concatenate([penalty, np.full(len(hard), HARD_CUT)])[order]


def best_cuts(place: np.ndarray, penalty: np.ndarray, window: int = WINDOW) -> list[int]:
    """The cheapest chain of places from 0 to the last one, by the monotone queue."""
    p, w = [0, *place.tolist()], [0.0, *penalty.tolist()]
    n = len(p)
    value, link = [0.0] * n, [0] * n
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for j in range(1, n):
        low = p[j] - window
        while p[queue[0][1]] < low:
            queue.popleft()
        front, i = queue[0]
        link[j] = i
        value[j] = w[j] + window - p[j] + front
        key = value[j] + p[j]
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    out, j = [], n - 1
    while j:
        out.append(p[j])
        j = link[j]
    return out[::-1]


def powers(n: int) -> list[int]:
    """n as falling powers of two: sequences of these lengths need no padding."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


class Packer:
    """Documents in, pieces out, in order; what does not fill a window yet waits for more."""

    def __init__(self, stops: np.ndarray, window: int = WINDOW, first_id: int = 0):
        self.stops, self.window, self.next_id = stops, window, first_id
        self.held: list[tuple[object, int, int, np.ndarray]] = []  # doc_id, start, doc_tokens, ids
        self.size = 0

    def add(self, doc_id, ids: np.ndarray) -> list[tuple]:
        self.held.append((doc_id, 0, len(ids), ids))
        self.size += len(ids)
        return self.pack(False) if self.size >= BLOCK else []

    def pack(self, last: bool) -> list[tuple]:
        """Pieces of all windows but the last one; with `last`, that too, in powers of two."""
        if not self.size:
            return []
        ids = np.concatenate([x[3] for x in self.held])
        ends = np.cumsum([len(x[3]) for x in self.held])
        chain = best_cuts(*cuts(ids, ends, self.stops), self.window)
        if last:
            tail = chain[-2] if len(chain) > 1 else 0
            chain = [*chain[:-1], *(tail + np.cumsum(powers(chain[-1] - tail))).tolist()]
        else:
            chain = chain[:-1]
        out, begin = [], ends - [len(x[3]) for x in self.held]
        low = k = 0
        for high in chain:
            size = high - low
            padded = size if size & (size - 1) == 0 else self.window
            at = low
            while at < high:
                doc_id, start, total, own = self.held[k]
                stop = min(high, int(ends[k]))
                skip = at - int(begin[k])
                piece = own[skip : skip + stop - at]
                out.append((doc_id, start + skip, stop - at, zlib.crc32(piece.astype("<u4").tobytes()), total, self.next_id, at - low, padded))
                at = stop
                k += stop == ends[k]
            self.next_id += 1
            low = high
        rest = [(d, s, t, x) for d, s, t, x in self.held[k:]]
        if rest and (skip := low - int(begin[k])) > 0:
            d, s, t, x = rest[0]
            rest[0] = (d, s + skip, t, x[skip:].copy())
        self.held, self.size = rest, len(ids) - low
        return out


def pack(docs: DataFrame, json_path: str, ranks_path: str, window: int = WINDOW) -> DataFrame:
    """One row for each piece of a document in a sequence of at most `window` tokens.

    Each input partition is packed by itself, in its order, without a shuffle; the sequence ids of
    a partition start at its number times 2^40. Its last tokens go into sequences of a power of
    two, which need no padding. Null or empty text: one token, the end id. Repeated rows are
    packed as often as they come; an empty table gives no rows.
    """
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length")])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(json_path, ranks_path)
        packer = Packer(enc.stops, window, TaskContext.get().partitionId() << 40)
        for batch in batches:
            out = []
            for part in common.slices(batch, "_text"):
                texts = common.texts_of(part.column(1))
                if len(texts[0]) <= CHECKED_BYTES:
                    enc.check(texts[0])
                for doc_id, text in zip(part.column(0).to_pylist(), texts, strict=True):
                    out += packer.add(doc_id, enc.ids(text))
            if out:
                yield common.batch_of(schema, zip(*out, strict=True))
        if out := packer.pack(True):
            yield common.batch_of(schema, zip(*out, strict=True))

    return common.arrow_map(docs.select("doc_id", F.col("text").alias("_text")), kernel, SCHEMA)

"""Encoding and decoding with merge-type (BPE) SentencePiece vocabularies.

The agenda holds adjacent symbol pairs whose concatenation is a piece, best score first, leftmost
first among equals. No piece has a space mark after another character, so that a text falls into
words that merge by themselves; each distinct word is worked out once and checked, ids and decoded
text, against the sentencepiece library. Short words run side by side in numpy, long ones on a heap.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm import common

SPACE = "▁"
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, library_agrees boolean"
#: Bytes that the words a worker remembers may take; then it starts anew. WORD_BYTES: of a word besides its strings.
REMEMBERED, WORD_BYTES = 260 << 20, 330
#: Characters from which a word uses the heap.
LONG_WORD = 200
_NONE = np.int64(1) << 30


class PieceModel:
    """A vocabulary read through the library, with the table of pairs that may merge."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib, size = self.library, self.library.get_piece_size()
        self.size, self.end = size, lib.eos_id()
        self.pieces = [lib.id_to_piece(i) for i in range(size)]
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if lib.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.plain = {p: i for i, p in enumerate(self.pieces) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))}
        if any(SPACE in p.lstrip(SPACE) for p in self.plain):
            raise ValueError("pieces with an inner space mark are not supported")
        if lib.encode("  a  ") != lib.encode("  a  ".replace(" ", SPACE)):
            raise ValueError("the model must escape white space and keep it")
        scores = [lib.get_score(i) for i in range(size)]
        order = {s: r for r, s in enumerate(sorted(set(scores), reverse=True))}
        self.rank = np.array([order[s] for s in scores], np.int64)
        self.symbol = size + np.arange(0x110000, dtype=np.int64)  # a character that is no piece
        for p, i in self.plain.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self.span = size + 0x110000
        pairs = {}
        for p, i in self.plain.items():
            for cut in range(1, len(p)):
                left, right = self._id(p[:cut]), self._id(p[cut:])
                if left is not None and right is not None:
                    pairs[left * self.span + right] = i
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def _id(self, text: str) -> int | None:
        found = self.plain.get(text)
        return int(self.symbol[ord(text)]) if found is None and len(text) == 1 else found

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged piece and its rank for pairs of symbols; rank _NONE where they do not merge."""
        key = left * self.span + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        merged = np.where(hit, self.merged[at], 0)
        return merged, np.where(hit, self.rank[merged], _NONE)

    def agenda(self, word: str) -> list[int]:
        """Symbols of one word by a heap of (rank, position)."""
        sym = self.symbol[np.frombuffer(word.encode("utf-32-le"), np.uint32)].tolist()
        n = len(sym)
        after, prior = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(left: int) -> None:
            right = after[left] if left >= 0 else n
            if right < n and (got := self.pairs.get(sym[left] * self.span + sym[right])) is not None:
                heapq.heappush(heap, (int(self.rank[got]), left, right, sym[left], sym[right], got))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, left, right, a, b, got = heapq.heappop(heap)
            if sym[left] != a or sym[right] != b or after[left] != right:
                continue
            sym[left], sym[right] = got, -1
            after[left] = after[right]
            if after[right] < n:
                prior[after[right]] = left
            offer(prior[left])
            offer(left)
        return [s for s in sym if s >= 0]

    def agendas(self, words: list[str]) -> list[list[int]]:
        """agenda() of many short words at once: each round merges the best pair of each word."""
        sym = self.symbol[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        length = np.array([len(w) for w in words], np.int64)
        name = np.arange(len(words))
        out: list[list[int]] = [[]] * len(words)
        last = np.zeros(len(sym), bool)
        last[np.cumsum(length) - 1] = True
        merged, rank = self._look(sym, np.append(sym[1:], 0))
        rank[last] = _NONE
        while len(name):
            start = np.cumsum(length) - length
            best = np.minimum.reduceat((rank << 32) | np.arange(len(sym)), start)
            going = (best >> 32) < _NONE
            if not going.all():
                keep = np.repeat(going, length)
                flat, low = sym[~keep].tolist(), 0
                for k, size in zip(name[~going].tolist(), length[~going].tolist(), strict=True):
                    out[k] = flat[low : low + size]
                    low += size
                shift = np.cumsum(~keep)
                sym, merged, rank, last = sym[keep], merged[keep], rank[keep], last[keep]
                best, name, length = best[going], name[going], length[going]
                if not len(name):
                    break
                at = best & 0xFFFFFFFF
                at = at - shift[at]
            else:
                at = best & 0xFFFFFFFF
            sym[at] = merged[at]
            last[at] = last[at + 1]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))
            sym, merged, rank, last = sym[keep], merged[keep], rank[keep], last[keep]
            length = length - 1
            near = np.concatenate([at, np.maximum(at - 1, 0)])  # some twice, with equal values
            right = sym[np.minimum(near + 1, len(sym) - 1)]
            merged[near], fresh = self._look(sym[near], right)
            fresh[last[near]] = _NONE
            rank[near] = fresh
        return out

    def words(self, text: str) -> list[str]:
        """Words of a text: space marks, then other characters; the text gets one mark in front."""
        return _WORD.findall((SPACE + text).replace(" ", SPACE)) if text else []

    def encode_words(self, words: list[str]) -> list[list[int]]:
        short = [w for w in words if len(w) < LONG_WORD]
        found = iter(self.agendas(short) if short else [])
        out = []
        for w in words:
            ids = next(found) if len(w) < LONG_WORD else self.agenda(w)
            if max(ids) >= self.size:  # characters that are no piece, as bytes
                ids = [i for s in ids for i in ([s] if s < self.size else [self.byte[b] for b in chr(s - self.size).encode()])]
            out.append(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids: bytes pieces as UTF-8, space marks as spaces, without the first space."""
        try:
            text = "".join([self._surface[i] for i in ids])
            return text[1:] if text[:1] == " " else text
        except TypeError:  # bytes or silent pieces among them
            pass
        parts, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                parts.append(run.decode("utf-8", "replace"))
                run = bytearray()
            if i in self._silent:
                continue
            parts.append(self.pieces[i].replace(SPACE, " "))
        parts.append(run.decode("utf-8", "replace"))
        text = "".join(parts)
        return text[1:] if text[:1] == " " else text

    @functools.cached_property
    def _silent(self) -> set[int]:
        return {i for i in range(self.size) if self.library.is_control(i)}

    @functools.cached_property
    def _surface(self) -> list[str | None]:
        return [None if i in self.byte_of or i in self._silent else p.replace(SPACE, " ") for i, p in enumerate(self.pieces)]

    @functools.cached_property
    def spelled(self) -> list[str]:
        return [str(i) for i in range(self.size)]

    def encode(self, text: str) -> list[int]:
        """Ids of a text with the end id."""
        return [i for ids in self.encode_words(self.words(text)) for i in ids] + [self.end]


_WORD = re.compile(f"{SPACE}+[^{SPACE}]*")


@functools.lru_cache(2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


class Memory:
    """What a worker knows about words: count, ids as text and decoded form; words that did not agree."""

    def __init__(self, model: PieceModel):
        self.model, self.known, self.bad, self.held = model, {}, set(), 0

    def learn(self, words: set[str]) -> None:
        """Work out the words that are new, by the agenda, and hold them against the library."""
        if self.held > REMEMBERED:
            self.known.clear()
            self.bad.clear()
            self.held = 0
        words = [w for w in words if w not in self.known]
        if not words:
            return
        model, spelled = self.model, self.model.spelled
        theirs = model.library.encode([w[1:].replace(SPACE, " ") for w in words], num_threads=1)
        if SPACE in words:  # the library sees a lone mark only after another word
            theirs[words.index(SPACE)] = model.library.encode("a ")[len(model.library.encode("a")) :]
        texts = model.library.decode(theirs, num_threads=1)
        for w, ids, ref, text in zip(words, model.encode_words(words), theirs, texts, strict=True):
            said = model.decode(ids)
            if ids != ref or said != text:
                self.bad.add(w)
                ids, said = ref, text
            self.known[w] = (len(ids), " ".join([spelled[i] for i in ids]), " " + said)
            self.held += WORD_BYTES + 2 * (len(w) + len(said)) + 6 * len(ids)


@functools.lru_cache(2)
def memory(path: str) -> Memory:
    return Memory(load(path))


def piece_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """Ids (with the end id) and decoded text of every row, as counts and digests.

    library_agrees is false where the agenda and the library gave other ids or text for a word;
    the library's are used there. Null text counts as empty: the end id alone. Rows stand alone,
    so repeated rows and empty tables need no rule; a text of any length is taken whole.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("library_agrees", pa.bool_())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = memory(model_path)
        model, known, bad = held.model, held.known, held.bad
        for batch in batches:
            for part in common.slices(batch, "_text"):
                split = [model.words(t) for t in common.texts_of(part.column(1))]
                held.learn(set().union(*split))
                rows = []
                for doc_id, words in zip(part.column(0).to_pylist(), split, strict=True):
                    got = [known[w] for w in words]
                    ids = " ".join([x[1] for x in got] + [str(model.end)])
                    text = "".join([x[2] for x in got])[1:]
                    agrees = not bad or bad.isdisjoint(words)
                    rows.append((doc_id, sum([x[0] for x in got]) + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), agrees))
                yield common.batch_of(schema, zip(*rows, strict=True))

    return common.arrow_map(docs.select("doc_id", F.col("text").alias("_text")), kernel, SCHEMA)

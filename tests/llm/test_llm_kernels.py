"""Kernels by themselves: memory of a group of the quality model, words and sets of all rows at once."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("public_tokenizers")
from siftwork.llm import common, jaccard_join, neardup, quality  # noqa: E402


def group(n, distinct=5000, docs=300, seed=3):
    """A group of _finisher() with made counts, and what its sums must be, word by word."""
    r = np.random.default_rng(seed)
    key = np.sort(r.choice(1 << 47, distinct, replace=False).astype(np.uint64))
    bits = r.integers(1000, 30_000, distinct).astype(np.uint64)
    number = r.integers(0, distinct, n).astype(np.uint32)
    key[7] = quality.REPEATED
    key.sort()
    size = np.diff(np.concatenate([[0], np.sort(r.choice(n, docs - 1, replace=False)), [n]]))
    counts = r.integers(0, 50, (5, distinct)).astype(np.uint64)
    ends = np.cumsum(size)
    prev = np.concatenate([np.roll(number[b - a : b], 1) for a, b in zip(size.tolist(), ends.tolist(), strict=True)])
    real = key[prev] != quality.REPEATED
    place, at = np.unique(quality.pair_places(key[prev[real]], key[number[real]], 1, np.zeros(0, np.uint64)), return_inverse=True)
    seen = r.integers(0, 9, len(place)).astype(np.uint64)
    meta = pa.StructArray.from_arrays([pa.array(np.arange(docs)), pa.array(np.arange(docs)), pa.array(["en"] * docs), pa.array(size * 5), pa.array(size)], fields=list(quality._META_TYPE.value_type))
    parts, of = 20, lambda x: np.array_split(x, 20)  # answers of shards, and slices of the documents
    cut = np.concatenate([[0], np.cumsum([len(x) for x in of(size)])])
    words_at = np.concatenate([[0], ends])[cut]
    rows = [(0, [quality.pack(c) for c in counts], None), (2, [quality.pack(key, True), quality.pack(bits)], None)]
    rows += [(1, [quality.pack(x)], None) for x in of(seen)]
    rows += [(3, [quality.pack(number[words_at[k] : words_at[k + 1]])], meta.slice(cut[k], cut[k + 1] - cut[k]).to_pylist()) for k in range(parts)]
    kind, blobs, lists = zip(*rows, strict=True)
    table = pa.table({"grp": [0] * len(rows), "shard": pa.array([0, 0, *range(parts), *range(parts)], pa.int32()), "kind": pa.array(kind, pa.int32()), "blobs": pa.array(blobs, pa.list_(pa.binary())), "meta": pa.array(lists, quality._META_TYPE)})
    words = quality.Words(None, True, (0.5, 1.0, 1.5), (0.4, 0.9, 1.4), 90_000, 0.2, None, 1, np.zeros(0, np.uint64))
    cont, total, one, two, more = counts.astype(np.int64)
    low = words.low(cont, bits.astype(float) / -1024)
    hand = np.where((total > 0) & (key != quality.REPEATED), (0.4 * one + 0.9 * two + 1.4 * more) / np.maximum(total, 1), 1.0)
    p = hand[prev] * low[number]
    c = seen[at].astype(np.int64)
    p[real] += np.where(c > 0, c - np.minimum(np.array([0, 0.4, 0.9, 1.4])[np.minimum(c, 3)], c), 0) / np.maximum(total, 1)[prev[real]]
    unit = np.rint(np.log2(np.maximum(p, 1e-300)) * quality.UNIT).astype(np.int64)
    sums = np.array([unit[b - a : b].sum() for a, b in zip(size.tolist(), ends.tolist(), strict=True)])
    return words, table, np.exp2(-sums / quality.UNIT / np.maximum(size * 5, 1))


def test_a_group_of_documents_takes_few_bytes_a_word():
    n = 1_500_000
    words, table, want = group(n)
    finish = quality._finisher(words)
    tracemalloc.start()
    out = finish(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(out.column("perplexity").to_numpy(), want, rtol=1e-12)
    assert peak < 40 * n, peak / n


def plain_hash(word):
    value = sum((b + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, b in enumerate(word)) + len(word)
    return int(common.mix64(np.array([value % (1 << 64)], np.uint64))[0])


def test_words_of_long_rows_are_hashed_as_by_themselves():
    long = "x" * 200_000  # longer than a block
    rows = ["Two words", None, "", f"a {long} b", "ends" * 3, "begins " + "w " * 40_000 + "end", "é\tü\n"]
    data, offsets = common.buffer_of(pa.array(rows, pa.string()))
    hashed, row, first = common.words_of(data, offsets, neardup.word_bytes(), common.ascii_lower(), (4,))
    want = [(k, w.lower().encode() if w.isascii() else w.encode()) for k, text in enumerate(rows) for w in (text or "").split()]
    assert row.tolist() == [k for k, _ in want]
    cache = {w: plain_hash(w) for w in {w for _, w in want} if len(w) < 1000}
    assert all(h == cache[w] for h, (_, w) in zip(hashed.tolist(), want, strict=True) if w in cache)
    x = want.index((3, long.encode()))
    assert hashed[x] == plain_hash(long.encode())
    value = [sum((b + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, b in enumerate(w[:4])) + (4 << 32) for w in (b"two", b"words")]
    assert first[:2].tolist() == common.mix64(np.array([v % (1 << 64) for v in value], np.uint64)).tolist()


def test_sets_names_and_places_of_all_rows_at_once_are_those_of_each_row():
    r = np.random.default_rng(5)
    rows = [" ".join(f"w{x}" for x in r.integers(0, 9, k)) for k in r.integers(0, 60, 200)] + [None, "", " ", "one", "One"]
    column = pa.array(rows, pa.string())
    flat, held = neardup.shingles_of(column, 3)
    each = [neardup.shingles_of(column.slice(k, 1), 3)[0] for k in range(len(rows))]
    assert held.tolist() == [len(x) for x in each] and np.array_equal(flat, np.concatenate(each))
    assert all((np.diff(x.astype(object)) > 0).all() for x in each)
    name_a, name_b = neardup.set_names(flat, held)
    for k, x in enumerate(each):
        assert name_a[k] == common.mix64(x).sum().astype(np.int64)
        assert name_b[k] == (np.bitwise_xor.reduce(common.mix64(x + np.uint64(77))).astype(np.int64) if len(x) else 0)
    frequent = np.sort(r.choice(flat, 40))
    place, at = jaccard_join.places(flat, held, frequent), 0
    for x in each:
        known = np.isin(x, frequent)
        inverse = np.argsort(np.concatenate([np.flatnonzero(~known), np.flatnonzero(known)]), kind="stable")
        assert place[at : at + len(x)].tolist() == inverse.tolist()
        at += len(x)

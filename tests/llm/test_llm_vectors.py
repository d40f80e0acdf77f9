"""Vector codes and the Jaccard join against brute force."""

import hashlib
import random

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
from test_llm_pairs import brute_components, made  # noqa: E402

from siftwork.llm import common, jaccard_join, neardup, vector_codes  # noqa: E402


def brute_codes(rows, parts, entries, rounds):
    """The contract, part by part in plain Python."""
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = max(1, -(-max((len(v) for _, v, _ in kept), default=0) // parts))
    cut = [[(v + [0] * (parts * width - len(v)))[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def nearest(part, book):
        d = [sum((x - y) ** 2 for x, y in zip(part, e, strict=True)) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(nearest(c[p], books[p])[0], []).append(c[p])
            for e, group in groups.items():
                books[p][e] = [sum(x) // len(group) for x in zip(*group, strict=True)]
    out, by = [], {}
    for (i, _, label), c in zip(kept, cut, strict=True):
        best = [nearest(c[p], books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{k:02x}" for k, _ in best), sum(d for _, d in best)))
        by[label] = by.get(label, 0) + out[-1][3]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, code, e, by[label], sha) for i, label, code, e in out), key=str)


VECTORS = "vec_id long, embedding array<float>, label int, code string, n int, ids string"


def vectors(n, seed=0):
    r = random.Random(seed)
    centres = [[r.uniform(-1, 1) for _ in range(8)] for _ in range(6)]
    rows = [(3 * i, [x + r.gauss(0, 0.1) for x in r.choice(centres)], r.choice([None, 1, 1, 1, 2])) for i in range(n)]
    rows += [(1, rows[0][1], 1), (1, rows[0][1], 1), (1, rows[1][1], None), (None, rows[2][1], 3), (7, rows[3][1][:5], 2), (8, [], 2)]
    rows += [(10, None, 1), (11, [0.5, None], 1), (12, [float("nan")] * 8, 1), (13, [float("-inf")] * 8, 9)]
    return [(i, None if v is None else [x if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]


@pytest.mark.parametrize("n,entries", [(150, 16), (4, 256)])
def test_codes_against_brute_force(spark, n, entries):
    rows = vectors(n)
    df = spark.createDataFrame([(*r, "clash", 5, "x") for r in rows], VECTORS).repartition(5)
    found = vector_codes.compress(df, entries=entries).collect()
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in found), key=str) == brute_codes(rows, 4, entries, 4)


def test_codes_of_no_rows_and_of_huge_numbers(spark):
    assert vector_codes.compress(spark.createDataFrame([], VECTORS)).count() == 0
    assert vector_codes.compress(spark.createDataFrame([(1, None, 1, "", 1, "")], VECTORS)).count() == 0
    with pytest.raises(ValueError, match="64 bits"):
        vector_codes.compress(spark.createDataFrame([(1, [1e30], 1, "", 1, "")], VECTORS))


def test_wide_numbers_use_wide_distances():
    books = vector_codes.Codebooks(np.array([[[0], [2**20]]]))
    index, error = books.nearest(np.array([[2**19, 2**19 + 1, -(2**20)]]))
    assert index.tolist() == [[0, 1, 0]] and error.tolist() == [[2**38, (2**19 - 1) ** 2, 2**40]]


@pytest.fixture(autouse=True)
def cells_on_small_tables(monkeypatch):
    monkeypatch.setattr(jaccard_join, "CELLS_FROM", 2)


def check_join(spark, rows, size, percent):
    df = spark.createDataFrame([(i, t, "kept", 5, 7) for i, t in rows], "doc_id long, text string, id string, n_shingles int, component int")
    found = jaccard_join.join(df, size, percent).collect()
    assert len(found) == len(rows)
    want, sets = brute_components([x for x in rows if x[0] is not None], size, percent)
    for r in found:
        assert r["component_id"] == (want[r["doc_id"]] if r["doc_id"] is not None else None)
        if r["doc_id"] is not None:
            assert r["n_shingles"] in [len(s) for s in sets[r["doc_id"]]]


@pytest.mark.parametrize("size,percent,seed", [(5, 80, 0), (3, 60, 1), (1, 90, 2)])
def test_join_against_brute_force(spark, size, percent, seed):
    rows = made(seed) + [(None, "same text again"), (1, "another text of the first id with some words more"), (4, "a b"), (4, "c d")]
    check_join(spark, rows, size, percent)


def test_join_needs_its_windows(spark):
    """Chains of texts at all distances, so that links run between members of different cells."""
    r = random.Random(5)
    rows = []
    for g in range(6):
        words = [f"g{g}w{k}" for k in range(60)]
        for k in range(12):
            rows.append((len(rows) * 7 % 1009, " ".join(words)))
            words = list(words)
            for _ in range(r.choice([1, 2, 3, 8])):
                words[r.randrange(60)] = f"n{g}x{k}y{r.randrange(10**6)}"
    common_part = [f"shared{k}" for k in range(60)]  # a passage in many texts that are not alike
    rows += [(2000 + i, " ".join([*common_part, *[f"own{i}w{k}" for k in range(60)]])) for i in range(60)]
    rows += [(3000 + i, " ".join([*common_part, *[f"tail{i // 5}w{k}" for k in range(12)], *[f"t{i}v{k}" for k in range(3)]])) for i in range(60)]
    check_join(spark, rows, 1, 80)
    check_join(spark, rows, 2, 70)


def test_join_of_no_rows_and_long_texts(spark):
    schema = "doc_id long, text string"
    assert jaccard_join.join(spark.createDataFrame([], schema)).count() == 0
    long = " ".join(f"w{k}" for k in range(60_000))
    rows = {r["doc_id"]: r for r in jaccard_join.join(spark.createDataFrame([(5, long), (9, long + " end"), (2, None), (3, " \n")], schema)).collect()}
    assert rows[9]["component_id"] == 5 and rows[9]["n_shingles"] == 59_997 and rows[2]["n_shingles"] == 0 and rows[3]["component_id"] == 3


def test_frequent_shingles_come_last():
    frequent = np.array([3, 8], np.uint64)
    assert jaccard_join.ordered(np.array([1, 3, 5, 8, 9], np.uint64), frequent).tolist() == [1, 5, 9, 3, 8]


def test_join_in_small_blocks_with_hot_keys(spark, monkeypatch):
    """Every key hot, long lists from three sets on, blocks of a few rows, no broadcast of pairs."""
    monkeypatch.setattr(common, "_hot", lambda table, total: jaccard_join.F.col("n") > 2)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(neardup, "BLOCK", 7)
    monkeypatch.setattr(jaccard_join, "SMALL_LIST", 2)
    check_join(spark, made(11, 6, 60), 3, 80)


def test_sketches_never_rule_out_a_link():
    """Sketches differ in at most as many places as the sets in shingles, also where their lengths differ."""
    r = np.random.default_rng(3)
    new = lambda n: r.integers(0, 2**64, n, np.uint64)
    sets = [np.sort(new(n)) for n in (1, 40, 64, 65, 100, 129, 500, 1000, 3000)]
    sets += [np.sort(np.concatenate([x[: int(0.9 * len(x))], new(k)])) for x in sets[1:] for k in (1, 5, 20)]
    size = np.array([len(x) for x in sets])
    words = jaccard_join._words_of(jaccard_join.sketches(np.concatenate(sets), size))
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    places = jaccard_join._places_apart(*words, a, b)
    apart = np.array([len(np.setxor1d(sets[i], sets[j])) for i, j in zip(a, b, strict=True)])
    assert (places <= apart).all() and (places[a == b] == 0).all() and (places[(apart > 500) & (np.minimum(size[a], size[b]) > 400)] > 100).all()
    far = apart / np.array([len(np.union1d(sets[i], sets[j])) for i, j in zip(a, b, strict=True)])
    assert (places <= jaccard_join.most_apart(size[a] + size[b], far)).all()


def passages(n=150, seed=4):
    """Texts that share a passage and are not alike, but for a few near copies of each eighth."""
    r = random.Random(seed)
    common_part, rows = [f"shared{k}" for k in range(40)], []
    for i in range(n):
        own = [f"own{i}w{k}" for k in range(60)]
        rows.append((3 * i + 1, " ".join([*common_part, *own])))
        for c in range(3 if i % 8 == 0 else 0):
            rows.append((3 * n + 3 * len(rows), " ".join([*common_part, *[w if r.random() > 0.03 else f"new{i}{c}{w}" for w in own]])))
    return rows


def test_sets_that_only_share_a_passage_do_not_meet(spark, monkeypatch):
    """Of long lists, full sets move only in families whose sketches allow links; before, all that a list holds met all."""
    met = []

    def meetings(here, *rest):
        met.append(here.count())
        return neardup_meetings(here, *rest)

    neardup_meetings = neardup.meetings
    monkeypatch.setattr(neardup, "meetings", meetings)
    monkeypatch.setattr(jaccard_join, "SMALL_LIST", 4)
    monkeypatch.setattr(jaccard_join, "CELLS_FROM", 10_000)  # no cells: every set is a pivot
    rows = passages()
    check_join(spark, rows, 1, 80)
    assert met and max(met) <= 0.5 * len(rows), (met, len(rows))


def test_join_in_rounds_and_in_cut_lists(spark, monkeypatch):
    """Pairs are looked at by sketches and measured in several rounds, long lists are cut into blocks."""
    rounds, one = [], neardup.set_table
    monkeypatch.setattr(neardup, "set_table", lambda *a: rounds.append(1) or one(*a))
    monkeypatch.setattr(jaccard_join, "_at_once", lambda held: 40_000)
    monkeypatch.setattr(jaccard_join, "LIST_ROWS", 16)
    monkeypatch.setattr(jaccard_join, "SKETCH_WORDS", 256)
    monkeypatch.setattr(jaccard_join, "SMALL_LIST", 6)
    check_join(spark, made(2), 3, 70)
    assert len(rounds) > 4
    monkeypatch.setattr(jaccard_join, "CELLS_FROM", 10_000)
    check_join(spark, passages(60) + [(1, "a second text of the first id " * 3)], 1, 80)


def test_texts_stay_where_they_are_when_most_rows_are_copies(spark, monkeypatch):
    """Of many copies the few nodes go to the texts; before, the copies' ids were too many to go there, and texts were shuffled."""
    joined, one = [], common.small_join

    def small_join(df, ids, key, how="inner", *rest):
        if "text" in df.columns:
            joined.append(ids.count())
        return one(df, ids, key, how, *rest)

    monkeypatch.setattr(common, "small_join", small_join)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 40)
    texts = [" ".join(f"t{k // 2}w{i}" for i in range(30)) + f" end{k}" for k in range(8)]
    check_join(spark, [(100 * c + k, x) for c in range(12) for k, x in enumerate(texts)] + [(1, "second text of an id"), (2000, "second text of an id")], 3, 80)
    assert joined and max(joined) <= 40

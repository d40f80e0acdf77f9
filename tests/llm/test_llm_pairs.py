"""Operators on pairs and the pipeline against brute force."""

import random
import re

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from siftwork.llm import common, components, neardup, topk  # noqa: E402


def brute_components(rows, size, percent):
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        shingles = {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} or ({tuple(words)} if words else set())
        sets.setdefault(i, []).append(shingles)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(s and t and 100 * len(s & t) >= percent * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, sets


def made(seed=0, groups=12, hot=90):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(4))
    rows = []

    def edited(words, share):
        return " ".join(word() if r.random() < share else w for w in words)

    for _ in range(groups):
        words = [word() for _ in range(r.randint(40, 120))]
        rows += [edited(words, r.choice([0, 0.01, 0.03, 0.06])) for _ in range(r.randint(1, 5))]
    words = [word() for _ in range(150)]
    rows += [edited(words, r.uniform(0, 0.08)) for _ in range(hot)]  # one large group of near copies
    rows += ["same text again"] * 40 + ["Same  TEXT\tagain", "two words", "two words", "", "", None, " \n"]
    r.shuffle(rows)
    return [(3 * i + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_near_duplicates_against_brute_force(spark, size, percent):
    rows = made() + [(None, "same text again")]
    df = spark.createDataFrame([(i, t, "kept", 5) for i, t in rows], "doc_id long, text string, kept string, n_shingles int")
    found = neardup.near_duplicates(df, size, percent).collect()
    want, sets = brute_components([x for x in rows if x[0] is not None], size, percent)
    assert len(found) == len(rows)
    for r in found:
        if r["doc_id"] is None:
            assert r["kept"] and r["component_id"] is None
            continue
        assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == want[r["doc_id"]])
        assert r["n_shingles"] == len(sets[r["doc_id"]][0])
    assert neardup.near_duplicates(df.limit(0), size, percent).count() == 0


def test_repeated_rows_are_one_node(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (3, "x")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(df, 3, 85).collect()) == [(1, 1), (1, 1), (2, 1), (3, 3)]
    assert sorted(r["doc_id"] for r in neardup.keep_one(df, 3, 85).collect()) == [1, 1, 3]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 101)], "a long, b long")
    scratch = common.Scratch(spark)
    found = {r["id"]: r["component"] for r in components.components(edges, scratch).collect()}
    assert scratch.n < 20
    assert all(found[i] == 0 for i in range(61)) and found[101] == found[100] == 100


def test_top_k_against_brute_force(spark):
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 0.4) for _ in range(8)]) for i in range(400)] + [(i, [0.25] * 8) for i in range(400, 460)] + [(460, [0.0] * 8), (500, None), (550, [1.0, float("nan")]), (600, [1.0, None]), (650, [float("inf")]), (700, [0.5, -0.5])]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, rank int, score double")
    import numpy as np

    ints = {}
    for i, v in rows:
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            ints[i] = np.zeros(8, int)
            ints[i][: len(v)] = np.floor(256 * np.float32(v).astype(float))
    want = []
    for q in ints:
        if q % 50 == 0:
            best = sorted((-int(ints[q] @ ints[c]), c) for c in ints if c != q)[:5]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    found = [(x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in topk.search(df).collect()]
    assert sorted(found) == sorted(want)
    assert topk.search(df.limit(0)).count() == 0


def test_pipeline_stages_keep_columns_and_rows(spark, tmp_path):
    rows = [(i, t, "en", "s", len(t or ""), "extra") for i, t in made(3, 6, 30)]
    rows.append((9001, "my mail is x.12@mail.example.com and that is all of it", "en", "s", 54, "extra"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, *_ in rows[:40]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    current = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, current, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == current.columns
            out.write.parquet(f"{tmp_path}/{k}")
            before, current = current, spark.read.parquet(f"{tmp_path}/{k}")
        if k == 2:
            left = [(r["doc_id"], r["text"]) for r in before.collect()]
            want, _ = brute_components(left, 5, 80)
            assert {r["doc_id"] for r in current.collect()} == {i for i, c in want.items() if i == c}
        if k == 3:
            assert "x.12@mail" not in " ".join(r["text"] or "" for r in current.collect())
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == {r["doc_id"] for r in current.collect()}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == out.count()


def test_a_repeated_id_with_several_texts_links_them(spark):
    df = spark.createDataFrame([(0, "a b c d"), (1, "a b c d"), (1, "e f g h"), (2, "e f g h"), (5, "x y z"), (5, "q r s t"), (6, "q r s t"), (7, "lone words here")], "doc_id long, text string")
    found = sorted((r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(df, 3, 85).collect())
    assert found == [(0, 0), (1, 0), (1, 0), (2, 0), (5, 5), (5, 5), (6, 5), (7, 7)]
    r = random.Random(9)
    rows = [(r.choice([i, i - 1, i - 2]) if i > 3 else i, t) for i, t in made(5, 8, 60)]
    rows = [(i + r.choice([0, 0, 0, 3]), t) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want, _ = brute_components(rows, 3, 85)
    assert all(x["component_id"] == want[x["doc_id"]] for x in neardup.near_duplicates(df, 3, 85).collect())


def test_hot_keys_and_small_blocks_lose_nothing(spark, monkeypatch):
    """With every key hot and blocks of a few rows, the result is that of brute force."""
    monkeypatch.setattr(common, "_hot", lambda table, total: neardup.F.col("n") > 2)
    monkeypatch.setattr(neardup, "BLOCK", 7)
    monkeypatch.setattr(neardup, "SMALL_BUCKET", 4)
    rows = made(7, 6, 70)
    want, _ = brute_components(rows, 3, 85)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(x["component_id"] == want[x["doc_id"]] for x in neardup.near_duplicates(df, 3, 85).collect())


def test_families_are_parted_by_size(spark):
    """Sets of very different sizes in one family never share a block; those that may link always do."""
    r = random.Random(12)
    rows = [(7, i, r.choice([10, 11, 13, 40, 45, 50, 400]), i if r.random() < 0.4 else 0) for i in range(200)]
    here = spark.createDataFrame(rows, "family long, id long, size int, component long")
    every, live = neardup.meetings(here, 0.8, common.Scratch(spark))
    found = every.collect()
    groups = {}
    for x in found:
        groups.setdefault((x["class"], x["_first"], x["_second"]), ([], []))[x["_side"]].append((x["id"], x["size"], x["component"]))
    met = set()
    for rest, every_ in groups.values():
        assert all(0.6 < a[1] / b[1] < 1.7 for a in rest for b in every_)
        met |= {tuple(sorted((a[0], b[0]))) for a in rest for b in every_}
    for _, i, n, c in rows:
        for _, j, m, e in rows:
            if i < j and c != e and min(n, m) >= 0.8 * max(n, m):
                assert (i, j) in met
    assert {x["id"] for x in live.collect()} == {x["id"] for x in found}

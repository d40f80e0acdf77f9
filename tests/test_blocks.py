"""Vectors that meet in blocks: the same rows as by comparing all pairs one by one."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwork.functions import vectors as V
from siftwork.operators import blocks, ingest, reports, retrieval, tracks

VECTORS = "id long, vec array<float>"


def plan(df):
    return df._jdf.queryExecution().toString()


def test_nearest_in_blocks_is_the_comparison_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(blocks, "PART", 37)
    monkeypatch.setattr(blocks, "BLOCK", 5)
    rng = np.random.default_rng(5)
    some = rng.normal(size=(40, 6)).round(2).tolist()
    vecs = [some[k % 40] if k < 120 else rng.normal(size=6).tolist() for k in range(150)]  # three copies each
    vecs[7], vecs[8], vecs[9], vecs[10] = None, [1.0, None, 0.0, 0.0, 0.0, 0.0], [1.0, 2.0], [float("nan")] * 6
    rows = spark.createDataFrame(list(enumerate(vecs)), VECTORS)
    queries = rows.where("id % 9 < 2").selectExpr("id as qid", "vec as qvec")
    for corpus, k in ((rows, 7), (rows.where("id BETWEEN 5 AND 12"), 20)):
        got = retrieval.knn(corpus, queries, k)
        pairs = corpus.crossJoin(queries).select("qid", "id", F.round(V.dot(F.col("vec"), F.col("qvec")), 6).alias("score"))
        want = retrieval.ranked(pairs, k)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))
        assert "CoGroup" in plan(got) and "NestedLoop" not in plan(got) and "CartesianProduct" not in plan(got)


def test_probed_buckets_do_not_make_a_pair_for_each_table(spark):
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rng.normal(size=(200, 8)))], VECTORS)
    near = retrieval.knn_approximate(rows, rows.where("id % 20 = 0").selectExpr("id as qid", "vec as qvec"), 5)
    assert "Generate explode(bucket" not in plan(near) and "CoGroup" in plan(near)
    exact = {(r.qid, r.id) for r in retrieval.knn(rows, rows.where("id % 20 = 0").selectExpr("id as qid", "vec as qvec"), 5).collect()}
    assert len(exact & {(r.qid, r.id) for r in near.collect()}) >= 0.9 * len(exact)


@pytest.mark.parametrize("few", [True, False])
def test_bm25_in_parts_is_the_sum_over_terms(spark, monkeypatch, few):
    r = random.Random(8)
    text = lambda n: " ".join(f"w{min(int(r.expovariate(0.1)), 60)}" for _ in range(n))
    texts = [text(r.randint(0, 30)) for _ in range(120)]
    texts[3], texts[4], texts[60:70] = None, "", texts[50:60]
    asks = [text(r.randint(1, 12)) for _ in range(15)] + ["unknown", "", None]
    monkeypatch.setattr(retrieval, "BROADCAST_QUERIES", 20_000 if few else 0)
    monkeypatch.setattr(retrieval, "PART_DOCS", 50)
    monkeypatch.setattr(retrieval, "CELLS", 64)
    monkeypatch.setattr(blocks, "BLOCK", 4)
    docs, asked = spark.createDataFrame(list(enumerate(texts)), "id long, text string"), spark.createDataFrame(list(enumerate(asks)), "qid long, text string")
    top = retrieval.bm25(docs, asked, 5)
    assert ("MapInPandas" if few else "CoGroup") in plan(top)  # pairs are added up in parts, not as rows
    words = {i: Counter(t.split()) for i, t in enumerate(texts) if t is not None}
    df = Counter(w for c in words.values() for w in c)
    raw = {w: math.log((len(texts) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    idf = {w: 0.25 * sum(raw.values()) / len(raw) if x < 0 else x for w, x in raw.items()}
    mean, want = sum(c.total() for c in words.values()) / len(words), set()
    for q, ask in enumerate(asks):
        score = lambda c: round(sum(n * idf[w] * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * c.total() / mean)) for w, n in Counter((ask or "").split()).items() if w in c), 6)  # noqa: B023, E731
        best = sorted((-score(c), i) for i, c in words.items() if score(c) > 0)[:5]
        want |= {(q, i, -s, rank) for rank, (s, i) in enumerate(best, 1)}
    assert {(x["qid"], x["id"], x["score"], x["rank"]) for x in top.collect()} == want


def test_a_search_runs_once_however_often_its_hits_are_read(spark):
    docs = spark.range(50).selectExpr("id", "concat('w', id % 7) AS text")
    hits = retrieval.bm25(docs, spark.range(7).selectExpr("id AS qid", "concat('w', id) AS text"), 3)
    assert "MapInPandas" not in plan(reports.lookup(hits, docs))
    found = ingest.resolve_grades(spark.createDataFrame([(1, "w3", 3)], "qid long, span string, grade int"), docs.selectExpr("id AS chunk_id", "'d' AS doc_id", "'s' AS section", "text"))
    assert "contains" not in plan(found).lower() and found.count() == 50


def test_identities_are_ranked_and_counted_without_a_row_for_each_pair(spark, monkeypatch):
    monkeypatch.setattr(blocks, "PART", 37)
    monkeypatch.setattr(blocks, "BLOCK", 5)
    monkeypatch.setattr(tracks, "STEP", 3)
    rng = np.random.default_rng(9)
    some = rng.normal(size=(40, 6)).round(1).tolist()
    vecs = [some[k % 40] if k < 120 else rng.normal(size=6).tolist() for k in range(150)]  # copies tie, also over parts
    vecs[7], vecs[8], vecs[9] = None, [1.0, None, 0.0, 0.0, 0.0, 0.0], [0.0] * 6
    identity = [None if k % 17 == 3 else k % 3 for k in range(150)]
    rows = spark.createDataFrame([(k, identity[k], k % 2, v) for k, v in enumerate(vecs)], "id long, identity int, camera long, vec array<float>")
    queries = rows.where("id % 9 < 2")
    ranks = tracks.rank_identities(rows, queries).cache()
    got, counts = tracks.identity_scores(rows, queries), tracks.distance_counts(rows, queries)
    assert all("CoGroup" in plan(x) or "MapInPandas" in plan(x) for x in (got, counts)) and "NestedLoop" not in plan(got) + plan(counts)
    hit = ranks.where("same").selectExpr("qid", "rank", "row_number() OVER (PARTITION BY qid ORDER BY rank) AS k")
    want = hit.groupBy("qid").agg(F.min("rank").alias("first"), F.avg(F.col("k") / F.col("rank")).alias("ap"))
    row = lambda x: (x["qid"], x["first"], round(x["ap"], 9))
    assert sorted(map(row, got.collect())) == sorted(map(row, want.collect()))
    sweep = tracks.tau_sweep(ranks.selectExpr("same", "round(1 - score, 6) AS distance"))
    assert sorted(tracks.sweep_counts(counts).collect()) == sorted(sweep.collect())
    ranks.unpersist()
